"""What the tests of this folder share."""

SF_DIR = "/root/testdata/sf0.01"
LONG = " ".join(f"word{k % 97} and{k % 13}" for k in range(30_000))
