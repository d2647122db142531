"""skarn.sources"""
