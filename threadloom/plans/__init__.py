"""threadloom.plans"""
