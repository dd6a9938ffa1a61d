"""cloakframe.plans"""
