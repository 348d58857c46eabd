"""feedmill.operators"""
