"""threadloom.functions"""
