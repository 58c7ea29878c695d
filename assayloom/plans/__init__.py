"""assayloom.plans"""
