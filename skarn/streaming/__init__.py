"""skarn.streaming"""
