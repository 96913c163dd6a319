"""Command line: python -m kinforge SOURCE1 SOURCE... --out FOLDER [options]."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .config import LinkConfig
from .operators.index import CandidateIndex, build_index, index_stats
from .operators.training import Cascade
from .operators.translit import apply_dictionary
from .plans.resolve import link, surrogate_score, train_and_link
from .sources.entities import read_dictionary, read_entities, read_truth, truth_pairs, write_table


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="kinforge", description="Links the records of the first source to those of the others.")
    p.add_argument("reference", help="records to link")
    p.add_argument("sources", nargs="+", help="candidate sources")
    p.add_argument("--out", required=True, help="folder of the results: matches.tsv, candidates.tsv")
    p.add_argument("--truth", help="true matches: fit the models on their training part, or evaluate what a saved model finds")
    p.add_argument("--models", help="saved cascade, or where to save it if it is fitted")
    p.add_argument("--index", help="saved index, or where to save it")
    p.add_argument("--rebuild-index", action="store_true", help="build the index even if a saved one exists")
    p.add_argument("--dictionary", help="words of Indic spelling and their Latin ones")
    p.add_argument("--no-translit", action="store_true", help="leave Indic words as they are")
    p.add_argument("--decode-mode", choices=["expected_f05", "threshold"], default="expected_f05")
    p.add_argument("--threshold", type=float, default=0.75, help="least probability of the threshold mode")
    p.add_argument("--max-entities", type=int, help="link so many records only, rounded up to chunks")
    p.add_argument("--chunk-size", type=int, default=4000, help="records of a chunk")
    return p.parse_args(argv)


def _loaded(read):
    """What ``read`` gives, or None if nothing is saved there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("kinforge").getOrCreate()
    config = LinkConfig()
    s1, sources = read_entities(spark, a.reference), [read_entities(spark, p) for p in a.sources]
    dictionary = read_dictionary(spark, a.dictionary) if a.dictionary and not a.no_translit else None
    truth = truth_pairs(read_truth(spark, a.truth)) if a.truth else None
    cascade = _loaded(lambda: Cascade.load(spark, a.models, config=config)) if a.models else None
    if cascade is None and truth is not None:
        trained, cascade = train_and_link(s1, sources, truth, config, dictionary)
        trained.release()
        if a.models:
            cascade.save(spark, a.models)
    index = _loaded(lambda: CandidateIndex.load(spark, a.index, config)) if a.index and not a.rebuild_index else None
    if index is None:
        index = build_index(sources, config, (lambda e: apply_dictionary(e, dictionary)) if dictionary is not None else None)
        if a.index:
            index.save(a.index)
            index = CandidateIndex.load(spark, a.index, config)
    index_stats(index).show()
    threshold = a.threshold if a.decode_mode == "threshold" else None
    linkage = link(s1, sources, cascade.score if cascade else surrogate_score, config, index=index, threshold=threshold, most=a.max_entities, chunk=a.chunk_size)
    write_table(linkage.lists(), f"{a.out}/matches.tsv")
    write_table(linkage.candidates(), f"{a.out}/candidates.tsv")
    if truth is not None:
        linkage.evaluate(truth.join(linkage.s1.select("s1_id"), "s1_id", "left_semi")).show()
    linkage.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
