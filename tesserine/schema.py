"""Schemas of the stored relations."""

ARTICLE = "id string, url string, title string, content string"
FRAGMENT = "id string, url string, title string, raw string"
PAGE = "page_id long, title string"
PAGE_LINK = "from_id long, to_id long"
LINK_TARGET = "lt_id long, lt_title string"
EDGE = "from_title string, to_title string"
ADJACENCY = "from_title string, linked_titles array<string>"
BACKLINKS = "title string, count long"
PASSAGE = "idx long, article_title string, text string"
TRIPLET = "anchor string, positive string, negative string, source string, url string"
TEST_QUERY = "query string, relevant_articles array<string>"
RESULT = "qid long, rank int, title string, url string, score double, cosine double, snippet string, reranked boolean"
