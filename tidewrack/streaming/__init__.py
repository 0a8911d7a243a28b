"""tidewrack.streaming"""
