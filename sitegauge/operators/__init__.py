"""sitegauge.operators"""
