"""A reading of small pages by the standard library's parser, to hold the SQL tokenizer against."""

from sieveline.operators.html import BLOCK_TAGS


def parsed_blocks(source: str) -> list[tuple[int, str, int, int]]:
    from html.parser import HTMLParser

    starts = [0]
    for line in source.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    found: list[tuple[int, str, int, int]] = []

    class Reader(HTMLParser):
        run, begun, level, depth, in_title = "", None, 0, 0, False

        def here(self):
            line, col = self.getpos()
            return starts[line - 1] + col

        def close_run(self, end):
            text = " ".join(self.run.split())
            if text and self.begun is not None:
                found.append((self.level, text, self.begun, max(end, self.begun + 1)))
            self.run, self.begun, self.level = "", None, 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.close_run(self.here())
                self.depth += 1
            elif tag == "title":
                self.in_title = True
            elif tag in BLOCK_TAGS and not self.depth:
                self.close_run(self.here())
                self.begun = self.here() + len(self.get_starttag_text())
                self.level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.depth = max(0, self.depth - 1)
            elif tag == "title":
                self.in_title = False
            elif tag in BLOCK_TAGS and not self.depth:
                self.close_run(self.here())

        def handle_data(self, data):
            if self.depth or self.in_title:
                return
            if self.begun is None and data.strip():
                self.begun = self.here()
            self.run += data

    r = Reader(convert_charrefs=True)
    r.feed(source)
    r.close()
    r.close_run(len(source))
    return found
