"""Readers and writers of FASTA, taxonomy tables, cluster reports and trees."""
