"""Small tables with the awkward cases, shared by the tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, bits string"


def texts(n: int = 120, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    words = ["the", "of", "é", "Fox", "fox", "a|b", "x#", "naïve", "日本", "12", "don't", "zz y"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(90))
    common = "A line that many of the documents share, word for word"
    out: list[str | None] = [None, "", " \t\n", "one", "two words", "\n\n\n", "tie tie tie tie tie tie", common, "  " + common.upper() + "\t"]
    while len(out) < n:
        kind = rng.randrange(6)
        body = " ".join(rng.choice(words) + (str(rng.randrange(400)) if rng.random() < 0.7 else "") for _ in range(rng.randrange(1, 220)))
        if kind == 0 and len(out) > 20:
            body = rng.choice([x for x in out[9:] if x])
        elif kind == 1 and len(out) > 20:
            old = rng.choice([x for x in out[9:] if x]).split(" ")
            old[rng.randrange(len(old))] = "changed"
            body = " ".join(old)
        elif kind == 2:
            cut = rng.randrange(40)
            body = body + "\n" + passage[cut:] + "\n" + body[: rng.randrange(1, 60)]
        elif kind == 3:
            body = body + "\n" + common + "\n" + body[:80] + "\n" + common + "\v"
        out.append(body)
    out.append(" ".join(rng.choice(words) for _ in range(30_000)))
    out.append(passage)
    return out


def documents(spark, n: int = 120, seed: int = 1):
    rows = [(i * 3 + 1, t, "en", f"s{i % 3}" if i % 7 else None, None, 5, "clash") for i, t in enumerate(texts(n, seed))]
    rows += rows[20:24]  # repeated rows
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows + [(None, "a row without an id, with some words", None, None, 1, None, None)], SCHEMA).repartition(3), rows
