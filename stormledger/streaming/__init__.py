"""stormledger.streaming"""
