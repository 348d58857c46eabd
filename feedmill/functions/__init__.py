"""feedmill.functions"""
