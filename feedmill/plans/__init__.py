"""feedmill.plans"""
