"""DataFrame operators, from paired decisions to marts and data tests."""
