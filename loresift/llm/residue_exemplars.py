"""Labelled exemplars of residue. Fixed values, collected by hand from pages without an article.

``SLOT`` stands for an unfilled placeholder of any notation.
"""

from __future__ import annotations

SLOT = "⟨slot⟩"

PLACEHOLDERS = [
    SLOT,
    f"The {SLOT} was built in {SLOT} by {SLOT}.",
    f"[object Object] {SLOT}",
    "Type: undefined. Owner: null. Built: NaN.",
    "TODO: write this section. TBD.",
    "Title goes here",
    "Insert description here. Insert text here.",
    "This is placeholder text. Replace it with your own words before publishing.",
    "Sample page",
    "Untitled",
    "Your content goes here. Add your text here.",
]

ERRORS = [
    "404 Not found. The page you asked for does not exist or was moved.",
    "Nothing here. Page missing. Oops! This link leads nowhere. Use the search instead.",
    "We could not find the page on this server.",
    "There is no text on this page yet. You can search for its title or create it.",
    "Page not found. The requested URL was not found on this server.",
    "Seite nicht gefunden. Die angeforderte Seite gibt es nicht.",
    "Página no encontrada. La dirección pedida no existe.",
    "Page introuvable. Cette adresse n'existe plus.",
    "Страница не найдена. Такого адреса нет.",
    "ページが見つかりません。指定されたページは存在しません。",
    "页面不存在。您访问的页面已被删除。",
    "Fatal error: cannot connect to database in /srv db.inc on line 0",
    "Traceback: TemplateError at variable is not defined (worker 0)",
    "500 Internal Server Error",
    "502 Bad Gateway front",
    "503 Service Unavailable",
    "504 Gateway Time-out",
    "Too many requests. Slow down. Your session has ended or you sent 0 requests in a minute. Wait and try again.",
    "Session expired. Please log in and try again.",
    "Request blocked. Forbidden. Access denied. You are not allowed to open this resource. Reference",
    "One more step. Checking your browser before you enter. This may take 0 seconds. Ray example",
    "Down for maintenance. is being updated and will be back in about 0 minutes.",
]

SCRIPTS = [
    "You must allow scripts in your browser to continue. One more step.",
    "Your browser blocks scripts; this app cannot start without them.",
    "Turn on scripts to open this page.",
    "JavaScript required. Please enable JavaScript to read the Wiki.",
    "This site needs scripts to run. Turn them on and reload.",
    "Scripts are switched off",
    "Bitte JavaScript einschalten.",
]

FILLER_STEMS = "lor ip sit am con ad el sed tur it et is sec cing te do sum".split()
FILLER_ENDINGS = "um us is am ae or et".split()
FILLER = [
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua dolorum ipsaem "
    + " ".join(stem + ending for stem in FILLER_STEMS for ending in FILLER_ENDINGS)
]

EXEMPLARS = [*PLACEHOLDERS, *ERRORS, *SCRIPTS, *FILLER]
