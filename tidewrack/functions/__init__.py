"""tidewrack.functions"""
