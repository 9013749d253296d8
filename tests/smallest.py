"""The smallest given tables, for tests."""

SF = "/root/testdata/sf0.001"
