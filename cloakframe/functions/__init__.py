"""cloakframe.functions"""
