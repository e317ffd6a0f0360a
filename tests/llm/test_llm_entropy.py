import random

from tallyfield.llm import quality

SCHEMA = "doc_id long, text string, lang string"


def verdicts(spark, docs):
    return {r.doc_id: r.kept for r in quality.quality_verdicts(spark.createDataFrame(docs, SCHEMA)).collect()}


def zipf(rng, n, vocabulary):
    return " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=n))


def test_entropy_is_compared_with_texts_of_like_length(spark):
    rng = random.Random(6)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    vocabulary = sorted({"".join(rng.choice(syllables) for _ in range(2)) for _ in range(3000)})
    rng.shuffle(vocabulary)
    # short texts among long ones, enough for a median of their own and too few for it
    for n_short in (30, 3):
        docs = [(i, zipf(rng, 800, vocabulary), "en") for i in range(40)] + [(100 + i, zipf(rng, 60, vocabulary), "en") for i in range(n_short)]
        kept = verdicts(spark, docs)
        assert all(kept.values())
    # a long text of few words among long ones, where short texts are the most
    poor = vocabulary[:25]
    docs = [(i, zipf(rng, 800, vocabulary), "en") for i in range(20)] + [(100 + i, zipf(rng, 60, vocabulary), "en") for i in range(40)]
    docs += [(900, " ".join(rng.choice(poor) for _ in range(800)), "en")]
    kept = verdicts(spark, docs)
    assert not kept.pop(900) and all(kept.values())
