"""Fixed values. Results depend on each of them, in this order where order is mentioned."""

#: Elements that are cut out before text is taken: by tag, class and role.
UNWANTED_TAGS = ("script", "style", "noscript", "iframe", "nav", "footer", "header", "aside")
UNWANTED_CLASSES = ("advertisement", "ads", "sidebar", "cookie-banner", "popup")
UNWANTED_ROLES = ("navigation", "banner", "contentinfo")
#: Where the main content is looked for; the first hit counts.
CONTENT_PLACES = (("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "content"), ("id", "content"), ("tag", "body"))
#: Function words by language; at equal scores the earlier language wins.
STOP_WORDS = {
    "en": "the is are was were have has been will would could should and but or for with",
    "es": "el la los las es son está están tiene tienen y pero para con que de",
    "fr": "le la les est sont avoir été pour avec que dans sur ce cette et",
    "de": "der die das ist sind haben wurde werden und aber für mit auf bei",
    "pt": "o a os as é são tem para com que de em por uma um",
    "it": "il la i le è sono ha per con che di in una un",
}
#: White space of ECMAScript, as a character class of Java's regular expressions.
WHITE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
REQUEST_CAP = 1000
PAGE_LIMIT, PAGE_LIMIT_MOST = 100, 500
TTL_MS = 3_600_000
SUMMARY_CHARS, HTML_LINKS, REPORT_ROWS = 500, 20, 10
MODES = ("CRAWL_ONLY", "SCRAPE_ONLY", "CRAWL_AND_SCRAPE")
FORMATS = ("JSON", "MARKDOWN", "SUMMARY", "LINKS_ONLY", "HTML")
EXTENSIONS = {"JSON": "json", "MARKDOWN": "md", "SUMMARY": "json", "LINKS_ONLY": "json", "HTML": "html"}
#: Of the report in the folder of an exported job.
EXPORT_EXTENSIONS = {"JSON": "json", "MARKDOWN": "md", "SUMMARY": "txt", "LINKS_ONLY": "txt", "HTML": "html"}
MIME_TYPES = {"json": "application/json", "md": "text/markdown", "html": "text/html"}
STATUSES = ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED")
PHASES = ("IDLE", "CRAWLING", "SCRAPING", "VALIDATING", "COMPLETED", "ERROR")
