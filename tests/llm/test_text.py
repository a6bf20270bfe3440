"""Markup and personal data."""

import numpy as np

from ledgerloom.llm import markup, pii, pii_examples

HTML = """<html><head><title>T</title><style>h1{}</style></head><body><!-- <h2>old</h2> --><script>var t='<h3>x</h3>'</script>
<H2 class="a">Pay &amp; <b>go</b></H2><ul><li>one <i>two</i><ul><li>inner</li></ul></li><li>three<li> </ul>
<pre class="x"><code>if a &lt; 3:\n  b</code></pre><p>Save $12.46 now, then $3.24. Here $$T = \\sum_i q$$ and \\(x\\).</p><script type="math/tex">r = 1</script></body></html>"""
MD = "Dear x,\n\n# Head **v1** #\n\nSetext\n======\n\n- a [link](http://x) b\n    - nested __bold__\n1. one\n\n```sql\nif a < 3\n```\n\n    indented()\n\nCost \\$5 and $y = 2$ \\*kept\\*\n"
WIKI = "== Head '''v2''' ==\n\n* a [http://x b c] d\n** [[Page|shown]] e\n# first\n# second\n\n<syntaxhighlight lang=\"text\">\nx < 1\n</syntaxhighlight>\n\nHere <math>z^2</math>."
TEX = "\\section*{A \\emph{b} \\& c}\n\\begin{itemize}\n\\item one \\textbf{two}\n\\begin{enumerate}\n\\item in \\pounds{}5\n\\end{enumerate}\n\\end{itemize}\n\\begin{verbatim}\nf(x) # y\n\\end{verbatim}\nWe \\[e = 1\\] and $d$ \\begin{equation}\nq\n\\end{equation} end \\\\"


def kinds(body):
    return {(k, t) for _, k, t, _ in markup.blocks(body) if k in markup.KINDS}


def test_html():
    assert kinds(HTML) == {("heading", "Pay & go"), ("list_item", "one two"), ("list_item", "inner"), ("list_item", "three"), ("code_block", "if a < 3: b"), ("formula", "T = \\sum_i q"), ("formula", "x"), ("formula", "r = 1")}


def test_markdown():
    assert kinds(MD) == {("heading", "Head v1"), ("heading", "Setext"), ("list_item", "a link b"), ("list_item", "nested bold"), ("list_item", "one"), ("code_block", "if a < 3"), ("code_block", "indented()"), ("formula", "y = 2")}
    assert "*kept*" in markup.visible_text(MD)


def test_wiki():
    assert kinds(WIKI) == {("heading", "Head v2"), ("list_item", "a b c d"), ("list_item", "shown e"), ("list_item", "first"), ("list_item", "second"), ("code_block", "x < 1"), ("formula", "z^2")}


def test_latex():
    assert kinds(TEX) == {("heading", "A b & c"), ("list_item", "one two"), ("list_item", "in £5"), ("code_block", "f(x) # y"), ("formula", "e = 1"), ("formula", "d"), ("formula", "q")}


def test_edges():
    assert markup.blocks(None) == [] and markup.blocks("") == []
    assert kinds("<h2>&nbsp;</h2><ul><li> </li></ul>") == set()
    for broken in ("<ul><li>a", "</li></ul></h2>", "<h1>a<h2>b", "```\nopen", "\\begin{itemize}\\item x", "<pre>", "<" * 500, "$" * 501, "[" * 3000, "*" * 3000, "_a" * 2000):
        markup.blocks(broken)
    long = "<p>" + "word " * 200_000 + "</p><h1>End</h1>"
    assert ("heading", "End") in kinds(long)


def test_structure(spark):
    rows = [(1, "a@h.example", HTML, "x"), (1, "a@h.example", HTML, "x"), (2, "b@h.example", "<div>\n" + MD + "\n</div>", "y"), (3, None, None, "z"), (4, "c@h.example", "# Lone line", "w")]
    df = spark.createDataFrame(rows, "delivery_id bigint, from_addr string, body_html string, path string")
    got = {(r.delivery_id, r.element, r.element_text) for r in markup.structure(df).collect()}
    assert {x for x in got if x[0] == 1} == {(1, *k) for k in kinds(HTML)}
    assert (4, "heading", "Lone line") in got and not any(x[0] == 3 for x in got)
    assert markup.structure(df.limit(0)).count() == 0
    assert markup.clean_text(df).where("delivery_id = 3 and clean is null").count() == 1


def test_clean_text_is_read_as_the_structure(spark):
    """A lone '#' line is a list item where the host writes wiki, in both results; every row gives one row."""
    rows = [(1, "a@w.example", WIKI), (2, "b@w.example", WIKI), (3, "c@w.example", "# Lone line"), (3, "c@w.example", "# Lone line"), (4, "d@m.example", "# Lone line"), (5, "e@w.example", None), (6, "f@w.example", ""), (None, "g@w.example", "# Other line")]
    df = spark.createDataFrame(rows, "delivery_id bigint, from_addr string, body_html string")
    assert {(r.element, r.element_text) for r in markup.structure(df).where("delivery_id = 3").collect()} == {("list_item", "Lone line")}
    got = [(r.delivery_id, r.clean) for r in markup.clean_text(df).collect() if r.delivery_id not in (1, 2)]
    assert sorted(got, key=str) == sorted([(3, "- Lone line"), (3, "- Lone line"), (4, "# Lone line"), (5, None), (6, ""), (None, "- Other line")], key=str)
    assert markup.clean_text(df.limit(0)).count() == 0


def test_losing_container_changes_the_output(spark):
    """A menu of links loses on its host; on one page of it stands real text, which stays."""
    menu = "<nav class='m1'><ul><li><a href='/a'>All offers of this week</a></li><li><a href='/b'>Help pages</a></li></ul></nav>"
    page = lambda n, top=menu: f"{top}<div><h1>Title {n}</h1><p>Your order of {n} mugs was packed today.</p></div>"
    rows = [(n, "shop@h.example", page(n)) for n in range(4)] + [(9, "shop@h.example", page(9, "<nav class='m2'><ul><li>Only words here</li></ul></nav>"))]
    df = spark.createDataFrame(rows, "delivery_id bigint, from_addr string, body_html string")
    full = {(r.delivery_id, r.element_text): r.chosen for r in markup.structure(df).collect()}
    assert full[0, "Help pages"] is False and full[0, "Title 0"] is True and full[9, "Only words here"] is True
    less = {(r.delivery_id, r.element_text) for r in markup.structure(df, fallback=False).collect()}
    assert (0, "Help pages") not in less and (0, "Title 0") in less and (9, "Only words here") in less
    clean = {r.delivery_id: r.clean for r in markup.clean_text(df).collect()}
    assert clean[1] == "# Title 1\nYour order of 1 mugs was packed today." and clean[9].startswith("- Only words here")


NAMES = pii.Names.of(["Marta Moldelski", "Wilf Moldargate"])


def found(text):
    tagger = pii.trained(NAMES)
    (spans,) = pii.find_spans([text], tagger)
    return {(k, pii.checked(k, text[a:b])) for a, b, k in spans}


def test_held_out_accuracy():
    """Frames that were never trained on, filled with other names, numbers and places."""
    train_on, kept_out = pii_examples.split_frames(0)
    tagger = pii.train(NAMES, frames=train_on)
    table = pii_examples.labelled_table([], per_frame=6, seed=99, frames=kept_out)
    right = wrong = missed = 0
    for (text, marked), spans in zip(table, pii.find_spans([t for t, _ in table], tagger)):
        want = {(k, pii.checked(k, text[a:b])) for a, b, k in marked}
        got = {(k, pii.checked(k, text[a:b])) for a, b, k in spans}
        right += len(want & got)
        wrong += len(got - want)
        missed += len(want - got)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.85


def test_sentences():
    assert found("Dear Dr Oskar Ulmowfeather,") == {("person_name", "Oskar Ulmowfeather")}
    assert ("phone", "+44 (0)7700 900653") in found("If plans change, ring +44 (0)7700 900653 or write to a.b@c.example.")
    assert ("address", "Flat 3, 12 Wexomill Hill, Tarnowold, QX9 9DP") in found("Deliver to: Pia Yarelby, Flat 3, 12 Wexomill Hill,\nTarnowold,\nQX9 9DP")
    assert found("Moldasen & Marroski Office, notice 48509") == set()
    assert found("Tracking 3143 5436 299 is on its way.") == set()


def test_personal_data_table(spark):
    rows = [(1, "Dear Mr Bram Wexarby,\r\ntext 07700 900123 on arrival.", "<p>Dear <b>Bram</b> Wexarby,</p>", ['"Wexarby, Bram" <bram@inbox.test>'], "x"), (2, None, None, None, "y"), (3, "", "", [], "z"), (4, "word " * 50_000, None, [None], "w")]
    df = spark.createDataFrame(rows, "delivery_id bigint, body_text string, body_html string, to_addrs array<string>, field_name string")
    block = spark.createDataFrame([("literal_name", n) for n in NAMES.some], "entry_kind string, entry_text string")
    got = {tuple(r) for r in pii.personal_data(df.unionByName(df), block).collect()}
    assert (1, "body_text", "person_name", "Bram Wexarby") in got and (1, "to_addrs", "email", "bram@inbox.test") in got and (1, "to_addrs", "person_name", "Wexarby, Bram") in got
    assert (1, "body_html", "person_name", "Bram Wexarby") in got and {g[0] for g in got} == {1}
    red = {r.delivery_id: r for r in pii.redacted(df, block).collect()}
    assert "[NAME]" in red[1].body_text and "Mr" in red[1].body_text and "Wexarby" not in red[1].body_text and "[PHONE]" in red[1].body_text
    assert red[2].body_text is None and red[2].to_addrs is None and red[3].to_addrs == []
    assert pii.personal_data(df.limit(0), None).count() == 0


def test_long_lines_are_tagged_whole():
    """An address of a very long line is found wherever it lies in it; the line has no sentence ends."""
    case = ("address", "Flat 3, 12 Wexomill Hill, Tarnowold, QX9 9DP")
    for n in range(380, 404):
        text = "please check the order " * (n // 4) + "now " * (n % 4) + f"Deliver to: Pia Yarelby, {case[1]}" + " and check the order" * 100
        assert case in found(text), n


def test_decode_has_no_length_of_its_own():
    """Tags of a sequence of many stretches equal those of the textbook recursion over all of it."""
    tagger = pii.trained(NAMES)
    tokens = ("Dear Dr Oskar Ulmowfeather , ring 07700 900653 or write to Pia Yarelby , 12 Wexomill Hill , Tarnowold , QX9 9DP now " * 60).split()
    (got,) = tagger.decode([tokens])
    rows = [tagger._row(t) if (i := tagger.memo.get(t)) is None else i for t in tokens]
    emit = np.array([sum(tagger.rows[rows[t + o], o + pii.REACH].astype(float) for o in range(-pii.REACH, pii.REACH + 1) if 0 <= t + o < len(rows)) for t in range(len(rows))])
    best, back = emit[0] + tagger.start, []
    for e in emit[1:]:
        both = best[:, None] + tagger.moves
        back.append(both.argmax(axis=0))
        best = both.max(axis=0) + e
    want = [int(best.argmax())]
    for came in reversed(back):
        want.append(int(came[want[-1]]))
    assert len(tokens) > 2 * pii.STRETCH and got.tolist() == want[::-1]
