"""Cluster a FASTA file: ``python -m cladeforge -i reads.fasta -r 500 -b 10 -o out``.

Writes ``clstr`` (report lines), ``members`` (Parquet), and on demand ``fasta`` and ``taxonomy`` (a folder for each cluster) and
``roots``. Under spark-submit the session of the cluster is used.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sequence as S
from .plans.clustering import Options, run, table
from .sources import files


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cladeforge", description=__doc__.split("\n")[0])
    parser.add_argument("-i", "--input", required=True, help="FASTA file or folder, plain or compressed")
    parser.add_argument("-r", "--sample", type=int, required=True, help="sequences sampled each round")
    parser.add_argument("-b", "--clusters", type=int, required=True, help="clusters a round is cut into")
    parser.add_argument("-o", "--output", required=True, help="folder of the results")
    parser.add_argument("-p", "--min-descendants", type=int, default=10, help="leaves above which a branch may be cut")
    parser.add_argument("-a", "--threshold", type=float, help="largest distance to a root; else the mean distance between clusters")
    parser.add_argument("-t", "--taxonomy", help="tab-separated names and lineages")
    parser.add_argument("-u", "--free-ends", action="store_true", help="align with free end gaps")
    parser.add_argument("-f", "--fasta", action="store_true", help="write each cluster's sequences")
    parser.add_argument("-q", "--roots", action="store_true", help="write the root sequences")
    parser.add_argument("--seed", type=int, default=42)
    return parser.parse_args(argv)


def checked(sequences: DataFrame) -> DataFrame:
    """Sequences with unique names; any letter but A C G T U N and gaps is an error, gaps go, U is read as T."""
    strange = sequences.filter(~S.is_dna(F.col("seq"))).select("name").limit(5).collect()
    if strange:
        raise ValueError(f"letters other than A C G T U N in {', '.join(r.name for r in strange)}")
    plain = sequences.withColumn("seq", F.translate(S.degap(F.col("seq")), "U", "T")).withColumn("len", F.length("seq"))
    return table(files.unique_names(plain), "sequences")


def cluster_files(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    sequences = checked(files.read_fasta(spark, args.input))
    options = Options(args.clusters, args.sample, args.min_descendants, args.threshold, "nw" if args.free_ends else "affine", args.seed)
    found, roots = run(sequences, options, lambda figures: print(", ".join(f"{k} {v}" for k, v in figures.items()), file=sys.stderr))
    members = table(found.join(sequences, "seq_id"), "members")
    files.write_clstr(members, f"{args.output}/clstr")
    members.select("round", "cluster_id", "seq_id", "name", "len", "via").write.mode("overwrite").parquet(f"{args.output}/members")
    if args.fasta:
        files.write_fasta(members, f"{args.output}/fasta", "cluster_id")
    if args.taxonomy:
        taxa = files.read_taxonomy(spark, args.taxonomy)
        files.write_taxonomy(members.join(taxa, "name", "left"), f"{args.output}/taxonomy", "cluster_id")
    if args.roots:
        files.write_roots(roots, f"{args.output}/roots")
    return members


def main() -> None:
    cluster_files(SparkSession.builder.appName("cladeforge").getOrCreate(), arguments())


if __name__ == "__main__":
    main()
