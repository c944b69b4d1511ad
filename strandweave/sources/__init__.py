"""Import and export formats around Parquet tables: FASTA, FASTQ, GFA, YAML, side files."""
