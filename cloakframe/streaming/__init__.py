"""cloakframe.streaming"""
