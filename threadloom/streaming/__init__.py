"""threadloom.streaming"""
