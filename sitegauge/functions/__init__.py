"""sitegauge.functions"""
