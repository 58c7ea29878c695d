"""assayloom.sources"""
