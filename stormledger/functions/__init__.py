"""stormledger.functions"""
