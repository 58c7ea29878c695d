"""assayloom.functions"""
