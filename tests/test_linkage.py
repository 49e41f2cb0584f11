"""Articles to notes and fuzzy names against all pairs, with the number of pairs that were looked at."""

import random
import re

from hearthbook.operators import linkage as ol


def words(text):
    return {w for w in re.findall(r"\w+", text.lower()) if len(w) > 4}


def test_articles_meet_notes_without_their_most_frequent_word(spark):
    rng = random.Random(4)
    vocabulary = [f"topic{i:03d}" for i in range(400)]
    title = lambda: " ".join(["Exhibition", *rng.sample(vocabulary, rng.randrange(1, 5))])
    articles = [(i, title(), rng.choice(["The Daily Herald", "Art Weekly", "of a"]), rng.choice([2001, 2002])) for i in range(300)]
    notes = [(f"{rng.choice(['2001', '2002', '20012'])} - {rng.choice(articles)[1] if rng.random() < 0.4 else title()} - {rng.choice(['herald', 'weekly', 'x'])}.md",) for _ in range(300)]
    want = {}
    for i, headline, publisher, year in articles:
        good = [f for f, in notes if str(year) in f and len(words(headline) & words(f)) >= 2 and any(w in f.lower() for w in publisher.lower().split() if len(w) > 3)]
        if good:
            want[i] = min(good)
    a = spark.createDataFrame(articles, "article_id long, headline string, publisher string, year int")
    n = spark.createDataFrame(notes, "file string")
    assert {r.article_id: r.file for r in ol.match_articles(a, n).collect()} == want and len(want) > 20
    looked_at = ol.article_candidates(a, n).select("article_id", "file").distinct().count()
    print(f"article candidates: {looked_at} of {len(articles) * len(notes)} pairs")
    assert looked_at < 0.05 * len(articles) * len(notes)
    assert ol.match_articles(a.limit(0), n).count() == 0
