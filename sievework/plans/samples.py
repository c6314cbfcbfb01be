"""Small inputs for cases that the tables don't hold."""

DOMAIN = "example.net"
BASE = f"http://{DOMAIN}/"
MODEL = "chat-small"
URLS = [
    f"https://www.{DOMAIN}:443/about/#x", f"http://cse.{DOMAIN}/", "/a/?b=1", "/a;v=1", "/x.pdf", f"http://{DOMAIN}//", "/logo.png/", "/logo.PNG",
    "#top", "", "mailto:a@b", f"ftp://{DOMAIN}/a", "https://facebook.com/x", f"http://evil{DOMAIN}/", f"http://{DOMAIN}:8080/a", f"http://www.{DOMAIN}/x.pdf", f"http://{DOMAIN}:80/x.pdf",
    f"http://{DOMAIN}/view.php?file=Exam%20Time.pdf&x=1", f"HTTP://WWW.{DOMAIN.upper()}/Dept/CSE/", f"http://{DOMAIN}", "  /padded  ",
]
HTML = [
    (f"http://{DOMAIN}/1", "<body><nav><h1>Menu</h1></nav><main><h1>Foo <b>Bar</b></h1><p>x <b>y</b></p><a>Read More</a></main><footer>f</footer></body>"),
    (f"http://{DOMAIN}/2", '<body><div class="navigation"><h1>Skip me</h1></div><h2>Real one</h2></body>'),
    (f"http://{DOMAIN}/3", "<body><p>a</p><footer>f</footer></body>"),
    (f"http://{DOMAIN}/4", "<main><table><tr><td>a</td><td></td><td>b</td></tr></table></main>"),
    (f"http://{DOMAIN}/5", '<p><a href="/docs/plan.pdf">Plan</a><a href="/other/plan.pdf"></a><iframe src="/c.pdf?v=2" title=" Third "></iframe></p>'),
    (f"http://{DOMAIN}/6", '<a href="/docs/plan.pdf#page=2">Again</a><embed src="/e.pdf" aria-label="Label"><object data="http://elsewhere.org/o.pdf"></object>'),
]
PAGE_TYPES = [("http://example.net/", "Faculty notice", ""), ("http://example.net/x", "Faculty notice", ""), ("http://example.net/x", "Alumni notice", ""), ("http://example.net/x", "Exam circular", ""), ("http://example.net/x", "Library", ""), ("http://example.net/a/index.php", "x", "y")]
EDGES = [("A", "B", False), ("A", "C", False), ("B", "D", False), ("C", "D", False), ("D", "A", False), ("D", "E", False), ("A", "p.pdf", True)]
NODES = [("A", True), ("B", True), ("C", False), ("D", True), ("E", True)]
DOCUMENT_TYPES = [(1, "Circular Sub: fee payment. Last date 10th"), (2, "circular notification"), (3, "notice"), (4, "hostel fee"), (5, "fees"), (6, ""), (7, "Sealed quotations are invited: call for quotation"), (8, "Unit - IV text books and course outcomes, CO2"), (9, "e-tender for bidders, EMD")]
CORPUS_RULES = """
licence_text: 6 licensed under; 4 license; 3 released under
rights_notice: 6 all rights reserved; 2 copyright
contact_data: 3 email|mail; 3 phone|call; 2 token|key|password
abusive: 2 idiot|moron|scum; 2 loser|clown|trash
"""
TABLES = [(1, "Head", [[["a", None, "b"], [None, ""]], [], [["c"]]]), (2, "", [[["", " "]]]), (3, None, [[[" x ", "y"]]]), (4, "only text ", [])]
REPLIES = [(1, 200, '{"choices":[{"message":{"content":" hi "}}]}'), (2, 200, '{"choices":[]}'), (3, 500, "oops"), (4, None, None), (5, 200, '{"choices":[{"message":{"content":"  "}}]}')]
