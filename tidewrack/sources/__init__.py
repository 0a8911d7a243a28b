"""tidewrack.sources"""
