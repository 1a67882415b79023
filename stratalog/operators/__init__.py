"""Set-oriented operators over cell logs and file catalogs."""
