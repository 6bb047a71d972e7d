"""threadloom.operators"""
