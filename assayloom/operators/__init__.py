"""assayloom.operators"""
