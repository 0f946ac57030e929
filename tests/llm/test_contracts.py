"""Contract columns and rank distances against plain computations."""

import collections
import zlib

from wagelens.llm import language_id, sharding

from ..conftest import SF_SMALL


def test_sharding_columns(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    rows = sharding.op7_sharding(spark, SF_SMALL).collect()
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_out_of_place_distances(spark):
    """The nearest profile by adding up, n-gram by n-gram, how far each stands from its place."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang", "text")
    profiles = language_id.learn(docs)
    places = {}
    for j, lang in enumerate(profiles.langs):
        places[lang] = {int(g): int(p) for g, p in zip(profiles.grams, profiles.place[:-1, j]) if p >= 0}
        assert sorted(places[lang].values()) == list(range(len(places[lang])))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.op3_language_id(spark, SF_SMALL).collect()}
    seen = 0
    for r in docs.collect():
        own = [int(g) for g in language_id.top_grams(r["text"])]
        if not own:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        most = language_id.PROFILE
        far = {lang: sum(abs(p[g] - i) if g in p else most for i, g in enumerate(own)) for lang, p in places.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - (1 - far[best] / (most * len(own)))) < 1e-12
        seen += 1
    assert seen > 100
