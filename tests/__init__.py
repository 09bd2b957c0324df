TABLES = "region nation customer supplier part orders lineitem events".split()
TINY = "/root/testdata/sf0.001"
