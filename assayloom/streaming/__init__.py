"""assayloom.streaming"""
