"""tidewrack.operators"""
