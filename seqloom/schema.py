"""Data model: constants and schemas of the sequence and presence relations."""

#: Bases of a k-mer.
K = 20
BASES = "ACGT"
#: Bases kept on each side of a k-mer in a profile, and all positions of one.
FLANK = 100
PROFILE_WIDTH = 2 * FLANK + K
#: Clustering: sketch size, shared hashes of a candidate pair, largest dual distance of an edge.
SKETCH, MIN_SHARED, MAX_DIST = 50, 37, 0.05

READS = "sample_id BIGINT, read_no INT, seq STRING"
SAMPLE_KMERS = "sample_id BIGINT, kmer STRING"
COUNTS = "kmer STRING, n BIGINT"
PRESENCE = "kmer STRING, samples ARRAY<BIGINT>"
PROFILE = "kmer STRING, pos INT, base STRING, n BIGINT"
ALIGNMENTS = "rname STRING, mapq INT, seq STRING"
GENE_KMERS = "gene STRING, kmers ARRAY<BIGINT>"
COMPONENTS = "comp INT, kmer STRING, loading DOUBLE"
EDGES = "src BIGINT, dst BIGINT"
