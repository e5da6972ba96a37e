"""Names of the binary markup of LIT books: elements by number, attributes by number."""

from __future__ import annotations

# Elements of packages.
PACKAGE = {
    1: "package", 2: "dc:Title", 3: "dc:Creator", 16: "manifest", 17: "item", 18: "spine", 19: "itemref", 20: "metadata", 21: "dc-metadata", 22: "dc:Subject", 23: "dc:Description", 24: "dc:Publisher",
    25: "dc:Contributor", 26: "dc:Date", 27: "dc:Type", 28: "dc:Format", 29: "dc:Identifier", 30: "dc:Source", 31: "dc:Language", 32: "dc:Relation", 33: "dc:Coverage", 34: "dc:Rights", 35: "x-metadata",
    36: "meta", 37: "tours", 38: "tour", 39: "site", 40: "guide", 41: "reference",
}
# Attributes of packages; those with a % are never written.
PACKAGE_ATTRIBUTES = {
    0x01: "href", 0x02: "%never-used", 0x03: "%guid", 0x04: "%minimum_level", 0x05: "%attr5", 0x06: "id", 0x07: "href", 0x08: "media-type", 0x09: "fallback", 0x0A: "idref", 0x0B: "xmlns:dc",
    0x0C: "xmlns:oebpackage", 0x0D: "role", 0x0E: "file-as", 0x0F: "event", 0x10: "scheme", 0x11: "title", 0x12: "type", 0x13: "unique-identifier", 0x14: "name", 0x15: "content", 0x16: "xml:lang",
}
# Elements of pages.
PAGE = {
    3: "a", 4: "acronym", 5: "address", 6: "applet", 7: "area", 8: "b", 9: "base", 10: "basefont", 11: "bdo", 12: "bgsound", 13: "big", 14: "blink", 15: "blockquote",
    16: "body", 17: "br", 18: "button", 19: "caption", 20: "center", 21: "cite", 22: "code", 23: "col", 24: "colgroup", 27: "dd", 28: "del", 29: "dfn", 30: "dir",
    31: "div", 32: "dl", 33: "dt", 34: "em", 35: "embed", 36: "fieldset", 37: "font", 38: "form", 39: "frame", 40: "frameset", 42: "h1", 43: "h2", 44: "h3", 45: "h4",
    46: "h5", 47: "h6", 48: "head", 49: "hr", 50: "html", 51: "i", 52: "iframe", 53: "img", 54: "input", 55: "ins", 56: "kbd", 57: "label", 58: "legend", 59: "li",
    60: "link", 61: "tag61", 62: "map", 63: "tag63", 64: "tag64", 65: "meta", 66: "nextid", 67: "nobr", 68: "noembed", 69: "noframes", 70: "noscript", 71: "object",
    72: "ol", 73: "option", 74: "p", 75: "param", 76: "plaintext", 77: "pre", 78: "q", 79: "rp", 80: "rt", 81: "ruby", 82: "s", 83: "samp", 84: "script", 85: "select",
    86: "small", 87: "span", 88: "strike", 89: "strong", 90: "style", 91: "sub", 92: "sup", 93: "table", 94: "tbody", 95: "tc", 96: "td", 97: "textarea", 98: "tfoot",
    99: "th", 100: "thead", 101: "title", 102: "tr", 103: "tt", 104: "u", 105: "ul", 106: "var", 107: "wbr",
}
# Attributes of any element of a page.
GLOBAL = {
    0x8010: "tabindex", 0x8046: "title", 0x804B: "style", 0x804D: "disabled", 0x83EA: "class", 0x83EB: "id", 0x83FE: "datafld", 0x83FF: "datasrc", 0x8400: "dataformatas",
    0x87D6: "accesskey", 0x9392: "lang", 0x93ED: "language", 0x93FE: "dir", 0x9771: "onmouseover", 0x9772: "onmouseout", 0x9773: "onmousedown", 0x9774: "onmouseup",
    0x9775: "onmousemove", 0x9776: "onkeydown", 0x9777: "onkeyup", 0x9778: "onkeypress", 0x9779: "onclick", 0x977A: "ondblclick", 0x977E: "onhelp", 0x977F: "onfocus",
    0x9780: "onblur", 0x9783: "onrowexit", 0x9784: "onrowenter", 0x9786: "onbeforeupdate", 0x9787: "onafterupdate", 0x978A: "onreadystatechange", 0x9790: "onscroll",
    0x9794: "ondragstart", 0x9795: "onresize", 0x9796: "onselectstart", 0x9797: "onerrorupdate", 0x9799: "ondatasetchanged", 0x979A: "ondataavailable",
    0x979B: "ondatasetcomplete", 0x979C: "onfilterchange", 0x979F: "onlosecapture", 0x97A0: "onpropertychange", 0x97A2: "ondrag", 0x97A3: "ondragend",
    0x97A4: "ondragenter", 0x97A5: "ondragover", 0x97A6: "ondragleave", 0x97A7: "ondrop", 0x97A8: "oncut", 0x97A9: "oncopy", 0x97AA: "onpaste", 0x97AB: "onbeforecut",
    0x97AC: "onbeforecopy", 0x97AD: "onbeforepaste", 0x97AF: "onrowsdelete", 0x97B0: "onrowsinserted", 0x97B1: "oncellchange", 0x97B2: "oncontextmenu",
    0x97B6: "onbeforeeditfocus",
}
# Attributes that mean the same wherever they stand.
COMMON = {
    0x0001: "href", 0x03F5: "n", 0x03F9: "media", 0x07D1: "type", 0x07D2: "rowspan", 0x07D4: "maxlength", 0x07D6: "readonly", 0x07D8: "indeterminate", 0x07D9: "usemap",
    0x07DA: "checked", 0x07DE: "vspace", 0x07DF: "hspace", 0x07E0: "lowsrc", 0x07E1: "vrml", 0x07E2: "dynsrc", 0x07E4: "loop", 0x07E5: "start", 0x1771: "scrolldelay",
    0x1772: "direction", 0x1773: "behavior", 0x1774: "scrollamount", 0x1775: "loop", 0x1776: "vspace", 0x1777: "hspace", 0x1778: "truespeed", 0x1B5A: "rows",
    0x1B5B: "cols", 0x1B5C: "wrap", 0x1B5D: "readonly", 0x8001: "name", 0x8006: "width", 0x8049: "align", 0x804A: "align", 0x8BB9: "src", 0x8BC2: "type",
    0x8BC3: "hidden", 0x8BC5: "vspace", 0x8BC6: "hspace", 0x8FA3: "hspace", 0x938A: "background", 0x938E: "nowrap", 0x9399: "clear", 0x939A: "type", 0x939B: "face",
    0x939C: "size", 0x93A3: "size", 0x93A5: "bordercolor", 0x93A6: "bordercolorlight", 0x93A7: "bordercolordark", 0x93A8: "valign", 0x93AE: "topmargin",
    0x93AF: "rightmargin", 0x93B0: "bottommargin", 0x93B1: "leftmargin", 0x93B6: "bgproperties", 0x93D8: "scroll", 0x93EE: "value", 0x977B: "onselect",
    0x977C: "onsubmit", 0x977D: "onreset", 0x9785: "onbounce", 0x978B: "onfinish", 0x978C: "onstart", 0x978D: "onabort", 0x978E: "onerror", 0x978F: "onchange",
    0x9791: "onload", 0x9792: "onunload", 0x9798: "onbeforeunload", 0x97B3: "onbeforeprint", 0x97B4: "onafterprint", 0xFE0C: "bgcolor",
}
# Attributes whose number means something of its own in an element.
OWN = {
    "a": {0x03EC: "target", 0x03EE: "rel", 0x03EF: "rev", 0x03F0: "urn", 0x03F1: "methods"},
    "applet": {0x8007: "height", 0x8BBB: "classid", 0x8BBC: "data", 0x8BBF: "codebase", 0x8BC0: "codetype", 0x8BC1: "code"},
    "area": {0x03EA: "shape", 0x03EB: "coords", 0x03ED: "target", 0x03EE: "alt", 0x03EF: "nohref"},
    "base": {0x03EC: "href", 0x03ED: "target"},
    "basefont": {0x938B: "color"},
    "bgsound": {0x03EA: "src", 0x03EB: "loop", 0x03EC: "volume", 0x03ED: "balance"},
    "body": {0x07DB: "link", 0x07DC: "alink", 0x07DD: "vlink", 0x938B: "text"},
    "col": {0x03EA: "span"},
    "colgroup": {0x03EA: "span"},
    "dl": {0x03EA: "compact"},
    "embed": {0x8007: "height", 0x8BBD: "palette", 0x8BBE: "pluginspage", 0x8BBF: "src", 0x8BC1: "units"},
    "font": {0x938B: "color"},
    "form": {0x03EA: "action", 0x03EC: "enctype", 0x03ED: "method", 0x03EF: "target", 0x03F4: "accept-charset"},
    "frame": {0x8000: "align", 0x8BBB: "border", 0x8BBC: "frameborder", 0x8BBD: "framespacing", 0x8BBE: "marginwidth", 0x8BBF: "marginheight", 0x8BC0: "noresize", 0x8BC1: "scrolling", 0x8FA2: "bordercolor"},
    "frameset": {0x03E9: "rows", 0x03EA: "cols", 0x03EB: "border", 0x03EC: "bordercolor", 0x03ED: "frameborder", 0x03EE: "framespacing"},
    "hr": {0x03EA: "noshade", 0x8007: "size", 0x938B: "color"},
    "iframe": {0x8007: "height", 0x8BBB: "border", 0x8BBC: "frameborder", 0x8BBD: "framespacing", 0x8BBE: "marginwidth", 0x8BBF: "marginheight", 0x8BC0: "noresize", 0x8BC1: "scrolling", 0x8FA2: "vspace"},
    "img": {0x03EB: "alt", 0x03EC: "src", 0x03ED: "border", 0x03EE: "vspace", 0x03EF: "hspace", 0x03F0: "lowsrc", 0x03F1: "vrml", 0x03F2: "dynsrc", 0x03F4: "loop", 0x03F6: "start", 0x07D3: "ismap", 0x8007: "height"},
    "input": {0x07D3: "size", 0x07DB: "alt", 0x07DC: "src", 0x07DD: "border", 0x8007: "height"},
    "label": {0x03E9: "for"},
    "li": {0x03EA: "value"},
    "link": {0x03EE: "href", 0x03EF: "rel", 0x03F0: "rev", 0x03F1: "type", 0x03FA: "target"},
    "tag63": {0x8007: "height"},
    "meta": {0x03EA: "http-equiv", 0x03EB: "content", 0x03EC: "url", 0x03F6: "charset"},
    "object": {0x8000: "usemap", 0x8007: "height", 0x8BBB: "classid", 0x8BBC: "data", 0x8BBF: "codebase", 0x8BC0: "codetype", 0x8BC1: "code"},
    "ol": {0x03EB: "compact", 0x03EC: "start"},
    "option": {0x03EA: "selected", 0x03EB: "value"},
    "param": {0x8000: "type"},
    "script": {0x03EA: "src", 0x03ED: "for", 0x03EE: "event", 0x03F0: "defer", 0x03F2: "type"},
    "select": {0x03EB: "size", 0x03EC: "multiple", 0x8000: "align"},
    "style": {0x03EB: "type", 0x03EF: "media"},
    "table": {0x03EA: "cols", 0x03EB: "border", 0x03EC: "rules", 0x03ED: "frame", 0x03EE: "cellspacing", 0x03EF: "cellpadding", 0x03FA: "datapagesize", 0x8007: "height"},
    "td": {0x07D3: "colspan", 0x8007: "height"},
    "th": {0x07D3: "colspan", 0x8007: "height"},
    "tr": {0x8007: "height"},
    "ul": {0x03EB: "compact"},
}


def attribute(element: str, number: int) -> str:
    """The name of a page's attribute; '' for unknown ones."""
    return OWN.get(element, {}).get(number) or COMMON.get(number) or GLOBAL.get(number, "")
