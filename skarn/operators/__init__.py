"""skarn.operators"""
