"""Training-data operators give the whole job on inputs with copies."""

import corpus_pipeline
from cases import prose

from feedloom.llm import main_text, set_join


def test_copied_pages_without_article_keep_their_texts(spark):
    menu = "Home News Sports Weather Contact About Terms Privacy Help"
    body = {i: prose(i, 60).split() for i in range(4)}
    near = [*body[0][:30], "edited", *body[0][31:]]
    texts = [(0, body[0]), (1, body[0]), (2, body[0]), (3, near), (4, body[1]), (5, body[2])]
    page = lambda w: f"<body><div>{menu}</div><h2>In short</h2><div>{' '.join(w)}</div></body>"
    pages = [(i, f"http://h.example/{i}", page(w)) for i, w in texts]
    # a host of copies only, and rows of one page_id with different texts
    pages += [(i, f"http://copies.example/{i}", page(body[3])) for i in (6, 7)]
    pages += [(8, "http://one.example/", page(body[1])), (8, "http://one.example/", page(body[2]))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {(r["page_id"], r["text"]) for r in main_text.extract(df).collect()}
    want = {(i, f"In short {' '.join(w)}") for i, w in texts}
    want |= {(i, f"{menu} In short {' '.join(w)}") for i, w in ((6, body[3]), (7, body[3]), (8, body[1]), (8, body[2]))}
    assert got == want


def test_a_menu_of_short_items_is_one_string(spark):
    menu = "".join(f"<li>{w}</li>" for w in "Home News Sports Weather Contact About Terms Privacy Help".split())
    pages = [(i, f"http://h.example/{i}", f"<body><ul>{menu}</ul><div>{prose(i, 40)}</div></body>") for i in range(3)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in main_text.extract(df).collect()} == {i: prose(i, 40) for i in range(3)}


def test_pipeline_links_near_copies_by_five_words(spark):
    base = prose(1, 51).split()
    inner = [*base[:25], "other", *base[26:]]  # 42 of 52 five-word shingles
    docs = [(9, base), (2, inner), (5, [*inner[:12], "more", *inner[13:]]), (7, prose(2, 51).split()), (1, "a b c d".split()), (3, "a b c d".split()), (4, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(3)

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [(i, shingles(w)) for i, w in docs]
    group = {i: i for i, _ in docs}
    for i, s in sets:
        for j, x in sets:
            if s and x and 100 * len(s & x) >= 80 * len(s | x):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == set(group.values()) and len(got) < len(docs)
    found = set_join.similar_components(df, **corpus_pipeline.NEAR).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(s), group[i]) for i, s in sets}
