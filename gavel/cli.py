"""Command line: python -m gavel moderate | inspect | tokenize | dump | bench | download."""

from __future__ import annotations

import argparse
import json
import sys
import time

from gavel.functions.text import DEFAULT_INSTRUCT, DEFAULT_QUERY, SYSTEM_CLOSE, SYSTEM_OPEN, SYSTEM_PROMPT, USER_CLOSE, USER_OPEN


def render(instruct: str, query: str, document: str) -> str:
    return f"{SYSTEM_OPEN}{SYSTEM_PROMPT}{SYSTEM_CLOSE}{USER_OPEN}<Instruct>: {instruct}\n\n<Query>: {query}\n\n<Document>: {document}{USER_CLOSE}"


def inspect(path: str) -> dict:
    """Metadata by key, and for each type its tensors and bytes, most bytes first."""
    from gavel.sources.gguf import GgufFile

    f = GgufFile(path)
    types: dict[str, list[int]] = {}
    for t in f.tensors:
        own = types.setdefault(t.kind.name if t.kind else str(t.code), [0, 0])
        own[0] += 1
        own[1] += t.size or 0
    return {
        "metadata": {k: f"{kind} of {len(v)}" if isinstance(v, list) else v for k, (kind, v) in sorted(f.metadata.items())},
        "types": [{"type": k, "tensors": n, "bytes": b} for k, (n, b) in sorted(types.items(), key=lambda x: (-x[1][1], x[0]))],
    }


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gavel")
    verbs = p.add_subparsers(dest="verb", required=True)
    m = verbs.add_parser("moderate")
    m.add_argument("model")
    m.add_argument("--instruct", default=DEFAULT_INSTRUCT)
    m.add_argument("--query", default=DEFAULT_QUERY)
    m.add_argument("--document")
    m.add_argument("--file")
    m.add_argument("--documents", help="a folder whose files are documents, moderated by Spark: a JSON line each")
    m.add_argument("--json", action="store_true")
    m.add_argument("--no-cache", action="store_true")
    m.add_argument("--cache-path")
    for verb in ("inspect", "bench"):
        verbs.add_parser(verb).add_argument("model")
    for verb in ("tokenize", "dump"):
        v = verbs.add_parser(verb)
        v.add_argument("model")
        v.add_argument("text")
    d = verbs.add_parser("download")
    d.add_argument("url")
    d.add_argument("path")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    try:
        if a.verb == "inspect":
            print(json.dumps(inspect(a.model), ensure_ascii=False, indent=1))
        elif a.verb == "download":
            from gavel.sources.download import fetch

            print(fetch(a.url, a.path))
        else:
            from gavel.operators.model import Model, Moderator

            if a.verb == "tokenize":
                print(json.dumps(Model(a.model).vocabulary.encode(a.text)))
            elif a.verb == "dump":
                from gavel.operators.moderate import activations

                print(json.dumps(activations(a.model, a.text)))
            elif a.verb == "bench":
                m = Moderator(a.model)
                began = time.time()
                n = sum(m.verdict(render(DEFAULT_INSTRUCT, DEFAULT_QUERY, "word " * 64))[3] for _ in range(5))
                print(json.dumps({"tokens_per_s": n / (time.time() - began)}))
            elif a.documents:
                from pyspark.sql import SparkSession

                from gavel.operators.moderate import moderate
                from gavel.sources.documents import read_documents

                spark = SparkSession.builder.getOrCreate()
                policy = spark.createDataFrame([(0, a.instruct, a.query)], "policy_id long, instruct string, query string")
                for line in moderate(read_documents(spark, a.documents), a.model, policy, use_prefix=not a.no_cache).toJSON().toLocalIterator():
                    print(line)
            else:
                began = time.time()
                text = a.document if a.document is not None else open(a.file).read() if a.file else sys.stdin.read()
                m = Moderator(a.model, not a.no_cache, a.cache_path)
                loaded = time.time()
                score, yes, no, n, held = m.verdict(render(a.instruct, a.query, text))
                if a.json:
                    print(json.dumps({"score": score, "unsafe_verdict": score > 0.5, "yes_logit": yes, "no_logit": no, "prompt_tokens": n, "prefilled_tokens": held, "load_ms": 1000 * (loaded - began), "inference_ms": 1000 * (time.time() - loaded)}))
                else:
                    print(f"{'UNSAFE' if score > 0.5 else 'safe'} score={score:.6f} (yes={yes:.4f} no={no:.4f})")
                    print(f"  {n} prompt tokens ({held} from the cached prompt), load {1000 * (loaded - began):.0f} ms, inference {1000 * (time.time() - loaded):.0f} ms")
    except Exception as e:  # noqa: BLE001  the exit code tells
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
