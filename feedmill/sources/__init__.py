"""feedmill.sources"""
