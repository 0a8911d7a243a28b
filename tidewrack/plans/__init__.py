"""tidewrack.plans"""
