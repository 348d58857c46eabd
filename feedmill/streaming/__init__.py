"""feedmill.streaming"""
