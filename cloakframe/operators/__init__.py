"""cloakframe.operators"""
