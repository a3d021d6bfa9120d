"""stormledger.sources"""
