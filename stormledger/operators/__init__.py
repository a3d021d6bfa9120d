"""stormledger.operators"""
