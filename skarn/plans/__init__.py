"""skarn.plans"""
