import pyarrow as pa

from tarnbeck.llm.decontaminate import Index, find_leaks, without_leaks

ITEM = "A train leaves Paris at 9 and travels 120 km to Lyon in 2 hours. What is its mean speed on the way to Lyon when 9 stops are made?"
AGAIN = ITEM.replace("Paris", "Rome").replace("Lyon", "Pisa").replace("9", "7").replace("120", "300").replace("2 hours", "3 hours")
BAD = ITEM.replace("to Lyon in", "to Bonn in").replace("9 stops", "4 stops").replace("at 9", "at 8")


def test_exact_reparameterised_and_inconsistent():
    index = Index([5], pa.array([ITEM]))
    filler = "some quite other words come first and go on for a while. "
    docs = [filler + ITEM, filler + AGAIN + " " + filler, filler * 9, None, "", BAD, ITEM.lower(), ITEM[:75], ITEM.replace("travels", "then travels").replace("mean speed", "mean road speed")]
    found = {t: (m, r, s) for t, _, m, r, s in index.leaks(pa.array(docs, pa.string()))}
    assert set(found) >= {0, 1, 6, 8} and not set(found) & {2, 3, 4}
    assert found[1][0] == found[0][0] and found[0][2] >= 4
    assert 5 not in found or found[5][0] < found[0][0]


def test_frames_blocks_nulls_and_clashing_columns(spark):
    filler = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    bench = spark.createDataFrame([(1, ITEM), (2, filler), (3, None), (None, "x"), (2, filler), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM, 7), (2, "zz " + filler, 8), (2, "zz " + filler, 8), (3, None, 9), (None, AGAIN, 1), (5, "", 1)], "doc_id long, text string, item_id int")
    whole = sorted(map(tuple, find_leaks(docs, bench).select("doc_id", "item_id").collect()), key=str)
    parts = sorted(map(tuple, find_leaks(docs, bench, most=120).select("doc_id", "item_id").collect()), key=str)
    assert whole == parts and len(whole) == 6 and (None, 1) in whole
    for most in (1 << 20, 120):
        assert sorted(r.doc_id for r in without_leaks(docs, bench, most).collect()) == [3, 5]
    assert find_leaks(docs.limit(0), bench).count() == 0 and find_leaks(docs, bench.limit(0)).count() == 0
    assert without_leaks(docs, bench.limit(0)).count() == 6


def test_verbatim_copies_of_any_item_and_no_single_hit():
    items = ["Compute 12 + 7 * 9 - 4.", "What is 2+2?", "Define entropy.", "In 1994 Anna Berg met Tom Hill at 7 in Oslo, 3 km from Ulm.", "the cat saw 3 Dogs 4 Cows", ITEM]
    index = Index(list(range(6)), pa.array(items))
    filler = "some quite other words come first and go on for a while. "
    docs = [filler + x + "\n" + filler for x in items] + [items[2], filler + 'He said: "What is 2+2?" And left.', ITEM.upper(), ITEM.title()]
    docs += ["so what is 2+2 worth", "they say the cat saw 3 Boats 9 times", filler + "then compute 12 + 7 more", "Yesterday the cat saw 3 Hens and left."]
    found = {(t, i) for t, i, *_ in index.leaks(pa.array(docs))}
    assert found == {(0, 0), (1, 1), (3, 3), (4, 4), (5, 5), (6, 2), (7, 1), (8, 5), (9, 5)}
    assert Index([1], pa.array(["What is 2+2?"])).found(pa.array([docs[1]])) == [(0, 0, 1, 1, 3, 0)]


def test_names_that_begin_sentences():
    item = "Tom has 12 apples. Tom gives 3 to Ann. Tom buys 7. How many apples has Tom?"
    other = "The mill in the old town was sold to Berta in 1901. Berta then let the wheel run day and night for the bakers."
    index = Index([1, 2], pa.array([item, other]))
    filler = "Some quite other words come first and go on for a while. "
    docs = [item, item.replace("Tom", "Sam"), filler + item.replace("Tom", "Sam").replace("Ann", "Eve").replace("12", "30") + " " + filler]
    docs += [other.replace("Berta", "Clara").replace("1901", "1850"), filler * 5, item.lower(), "Yes. No. Tom. Ann. Sam. Eve. Bob. " * 9, "Now " + other.replace("The mill", "the mill")]
    swapped = item.replace("Tom has", "Sam has").replace("Tom gives", "Eve gives").replace("Tom buys", "Joe buys").replace("has Tom", "has Bob")
    found = {(t, i): x for t, i, *x in index.leaks(pa.array([*docs, swapped]))}
    assert set(found) - {(8, 0)} == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 0), (7, 1)}
    assert (8, 0) not in found or found[8, 0][0] < found[1, 0][0]


def test_every_reading_of_a_window():
    one, two = (Index([1], pa.array([x])) for x in ("We left. Tom ran home fast", "Then left. Sam ran home fast"))
    assert len(one.template.hash) > one.template.n_windows[0] == 2
    assert set(one.template.hash.tolist()) & set(two.template.hash.tolist())
