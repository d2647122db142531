"""skarn.functions"""
