"""cloakframe.sources"""
