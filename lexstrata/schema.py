"""Table schemas (Spark DDL) and the fixed names of the data model."""

from __future__ import annotations

CREDITS = "array<struct<ref_pairs: array<struct<ref_id: string, description: string>>>>"
DOCUMENT_TYPE = "struct<kind: string, usc_type: string, bill_type: string, bill_id: string>"
ELEMENTS = (
    "snapshot_date date, path string, parent_path string, ancestor_paths array<string>, depth int, ordinal int, ord_path array<int>, "
    f"shadowed boolean, element_type string, document_type {DOCUMENT_TYPE}, number_value string, number_display string, verbose_name string, "
    "heading string, chapeau string, proviso string, content string, continuation string, uslm_id string, uslm_uuid string, "
    f"source_credits {CREDITS}"
)
ERROR = "struct<code: string, message: string>"
AMENDMENTS = "bill_id string, amendment_id string, action_types array<string>, amending_text string, ordinal int"
BILL_DIFFS = "bill_id string, amendment_id string, diff_ordinal int, added array<string>, removed array<string>"
CHANGES = "array<struct<value: string, old_index: int, new_index: int, tag: string>>"
FIELD_CHANGES = f"from_date date, to_date date, path string, field_name string, old_value string, new_value string, changes {CHANGES}"
ANNOTATIONS = (
    "annotation_id long, from_date string, to_date string, operation string, bill_id string, amendment_id string, causative_text string, "
    "paths array<string>, status string, confidence float, annotator string, ts timestamp, notes string, reasoning string"
)
TERMS = "array<struct<congress: int, chamber: string, state: string, district: int, start_year: int, end_year: int>>"
MEMBERS = f"bioguide_id string, name string, first_name string, last_name string, party string, state string, district int, chamber string, terms {TERMS}"
SPONSORS = "bill_id string, sponsor string, cosponsors array<struct<bioguide_id: string, date: string, withdrawn: boolean>>"
VERSIONS = "snapshot_date string, label string, seq long"
DOWNLOADS = "bill_id string, bill_xml string, sponsors_json string, cosponsors_json string, member_jsons map<string,string>, votes_json string"

#: The text fields of an element, in the order in which differences are listed.
TEXT_FIELDS = ("heading", "chapeau", "proviso", "content", "continuation")
#: The order in which search looks through them.
SEARCH_FIELDS = ("heading", "chapeau", "content", "proviso", "continuation")
#: Element tags, by their lower-case names.
ELEMENT_TYPES = (
    "title subtitle chapter subchapter part subpart section subsection paragraph subparagraph clause subclause level item subitem subsubitem "
    "division subdivision appendix"
).split()
#: Other names of the two document elements.
DOCUMENT_ALIASES = {"publiclaw": "publiclawdocument", "public_law": "publiclawdocument", "plaw": "publiclawdocument", "uscode": "uscodedocument", "us_code": "uscodedocument", "uscdoc": "uscodedocument"}
#: Amending actions and their other spelling.
ACTIONS = ("amend", "add", "delete", "insert", "redesignate", "repeal", "move", "strike", "strike_and_insert")
ACTION_ALIASES = {"strikeandinsert": "strike_and_insert"}
#: Parties and chambers with their aliases.
PARTIES = {"D": "Democrat", "Democrat": "Democrat", "Democratic": "Democrat", "R": "Republican", "Republican": "Republican", "I": "Independent", "ID": "Independent", "Independent": "Independent"}
CHAMBERS = {"Senate": "Senate", "senate": "Senate", "S": "Senate", "House": "House", "house": "House", "H": "House", "House of Representatives": "House"}
STATUSES = ("Pending", "Verified", "Disputed", "Rejected")
#: Words that say nothing about a change.
STOP_WORDS = (
    "a an the and or of in to by at on with is are was were be been being it its as all each into up out do does did have has had they them "
    "their there this these those that"
).split()
