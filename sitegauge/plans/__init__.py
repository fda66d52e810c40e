"""sitegauge.plans"""
