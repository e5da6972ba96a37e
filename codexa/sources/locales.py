"""Windows locale codes of books: language tags and charsets."""

from __future__ import annotations

# Language tags of the locale codes of Palm books.
PALM = {
    0x0004: "zh-Hans", 0x0401: "ar-SA", 0x0402: "bg", 0x0403: "ca", 0x0404: "zh-TW", 0x0405: "cs", 0x0406: "da", 0x0407: "de-DE", 0x0408: "el", 0x0409: "en-US",
    0x040A: "es-ES", 0x040B: "fi", 0x040C: "fr-FR", 0x040D: "he", 0x040E: "hu", 0x040F: "is", 0x0410: "it-IT", 0x0411: "ja", 0x0412: "ko", 0x0413: "nl-NL", 0x0414: "nb",
    0x0415: "pl", 0x0416: "pt-BR", 0x0417: "rm", 0x0418: "ro", 0x0419: "ru", 0x041A: "hr", 0x041B: "sk", 0x041C: "sq", 0x041D: "sv-SE", 0x041E: "th", 0x041F: "tr",
    0x0420: "ur", 0x0421: "id", 0x0422: "uk", 0x0423: "be", 0x0424: "sl", 0x0425: "et", 0x0426: "lv", 0x0427: "lt", 0x0429: "fa", 0x042A: "vi", 0x042B: "hy",
    0x042C: "az-Latn", 0x042D: "eu", 0x042F: "mk", 0x0432: "tn", 0x0434: "xh", 0x0435: "zu", 0x0436: "af", 0x0437: "ka", 0x0438: "fo", 0x0439: "hi", 0x043A: "mt",
    0x043B: "se-NO", 0x043E: "ms-MY", 0x043F: "kk", 0x0440: "ky", 0x0441: "sw", 0x0443: "uz-Latn", 0x0444: "tt", 0x0446: "pa", 0x0447: "gu", 0x0449: "ta", 0x044A: "te",
    0x044B: "kn", 0x044E: "mr", 0x044F: "sa", 0x0450: "mn", 0x0452: "cy", 0x0456: "gl", 0x0457: "kok", 0x045A: "syr", 0x0461: "ne", 0x0462: "fy", 0x0463: "ps",
    0x0464: "fil", 0x0465: "dv", 0x046B: "qu-BO", 0x046C: "nso", 0x046E: "lb", 0x047A: "arn", 0x047C: "moh", 0x0481: "mi", 0x0801: "ar-IQ", 0x0804: "zh-CN",
    0x0807: "de-CH", 0x0809: "en-GB", 0x080A: "es-MX", 0x080C: "fr-BE", 0x0810: "it-CH", 0x0813: "nl-BE", 0x0814: "nn", 0x0816: "pt-PT", 0x081A: "sr-Latn-RS",
    0x081D: "sv-FI", 0x082C: "az-Cyrl", 0x083B: "se-SE", 0x083C: "ga", 0x083E: "ms-BN", 0x0843: "uz-Cyrl", 0x085D: "iu-Latn", 0x086B: "qu-EC", 0x0C01: "ar-EG",
    0x0C04: "zh-HK", 0x0C07: "de-AT", 0x0C09: "en-AU", 0x0C0A: "es-ES", 0x0C0C: "fr-CA", 0x0C1A: "sr-Cyrl-RS", 0x0C3B: "se-FI", 0x0C6B: "qu-PE", 0x1001: "ar-LY",
    0x1004: "zh-SG", 0x1007: "de-LU", 0x1009: "en-CA", 0x100A: "es-GT", 0x100C: "fr-CH", 0x101A: "hr-BA", 0x103B: "smj-NO", 0x1401: "ar-DZ", 0x1404: "zh-MO",
    0x1407: "de-LI", 0x1409: "en-NZ", 0x140A: "es-CR", 0x140C: "fr-LU", 0x141A: "bs-Latn", 0x143B: "smj-SE", 0x1801: "ar-MA", 0x1809: "en-IE", 0x180A: "es-PA",
    0x180C: "fr-MC", 0x181A: "sr-Latn-BA", 0x183B: "sma-NO", 0x1C01: "ar-TN", 0x1C09: "en-ZA", 0x1C0A: "es-DO", 0x1C1A: "sr-Cyrl-BA", 0x1C3B: "sma-SE", 0x2001: "ar-OM",
    0x2009: "en-JM", 0x200A: "es-VE", 0x201A: "bs-Cyrl", 0x203B: "sms", 0x2401: "ar-YE", 0x2409: "en-029", 0x240A: "es-CO", 0x243B: "smn", 0x2801: "ar-SY",
    0x2809: "en-BZ", 0x280A: "es-PE", 0x2C01: "ar-JO", 0x2C09: "en-TT", 0x2C0A: "es-AR", 0x3001: "ar-LB", 0x3009: "en-ZW", 0x300A: "es-EC", 0x3401: "ar-KW",
    0x3409: "en-PH", 0x340A: "es-CL", 0x3801: "ar-AE", 0x380A: "es-UY", 0x3C01: "ar-BH", 0x3C0A: "es-PY", 0x4001: "ar-QA", 0x400A: "es-BO", 0x440A: "es-SV",
    0x480A: "es-HN", 0x4C0A: "es-NI", 0x500A: "es-PR", 0x7C04: "zh-Hant",
}
# Language tags of compiled help, by whole code, else by primary language (the low ten bits).
HELP_WHOLE = {0x0404: "zh-Hant", 0x0804: "zh-Hans", 0x081A: "sr-Latn", 0x0C04: "zh-Hant", 0x0C1A: "sr-Latn", 0x1004: "zh-Hans", 0x1404: "zh-Hant"}
HELP = {
    0x01: "ar", 0x02: "bg", 0x03: "ca", 0x04: "zh-Hans", 0x05: "cs", 0x06: "da", 0x07: "de", 0x08: "el", 0x09: "en", 0x0A: "es", 0x0B: "fi", 0x0C: "fr", 0x0D: "he",
    0x0E: "hu", 0x0F: "is", 0x10: "it", 0x11: "ja", 0x12: "ko", 0x13: "nl", 0x14: "no", 0x15: "pl", 0x16: "pt", 0x17: "rm", 0x18: "ro", 0x19: "ru", 0x1A: "sr",
    0x1B: "sk", 0x1C: "sq", 0x1D: "sv", 0x1E: "th", 0x1F: "tr", 0x20: "ur", 0x21: "id", 0x22: "uk", 0x23: "be", 0x24: "sl", 0x25: "et", 0x26: "lv", 0x27: "lt",
    0x2C: "az", 0x2D: "eu", 0x2E: "hsb", 0x2F: "mk", 0x36: "af", 0x37: "ka", 0x39: "hi", 0x3E: "ms", 0x41: "sw", 0x43: "uz", 0x44: "tt", 0x45: "bn", 0x46: "pa",
    0x47: "gu", 0x48: "or", 0x49: "ta", 0x4A: "te", 0x4B: "kn", 0x4C: "ml", 0x4D: "as", 0x4E: "mr", 0x4F: "sa", 0x50: "mn", 0x52: "cy", 0x53: "kh", 0x54: "lo",
    0x56: "gl", 0x57: "kok", 0x5E: "vi", 0x61: "ne", 0x62: "fy",
}
# Charsets of compiled help, by whole code, else by primary language, else windows-1252.
CHARSET_WHOLE = {0x0404: "big5", 0x0411: "shift_jis", 0x0412: "euc-kr", 0x041E: "windows-874", 0x042A: "windows-1258", 0x0804: "gbk", 0x0C04: "big5", 0x1004: "gbk", 0x1404: "big5"}
CHARSET_PRIMARY = {
    "windows-1250": (0x05, 0x0E, 0x15, 0x18, 0x1A, 0x1B, 0x24, 0x25, 0x26, 0x27, 0x2E), "windows-1251": (0x02, 0x19, 0x22, 0x23, 0x2F, 0x43, 0x44), "windows-1253": (0x08,), "windows-1254": (0x1F, 0x2C),
    "windows-1255": (0x0D,), "windows-1256": (0x01, 0x20), "windows-1257": (0x3E,),
}
_CHARSETS = {primary: name for name, many in CHARSET_PRIMARY.items() for primary in many}


def palm_language(code: int) -> str:
    """The tag of a Palm book's locale; '' for unknown ones."""
    return PALM.get(code & 0xFFFF, "")


def help_language(code: int) -> str:
    return HELP_WHOLE.get(code) or HELP.get(code & 0x3FF, "")


def help_charset(code: int) -> str:
    return CHARSET_WHOLE.get(code) or _CHARSETS.get(code & 0x3FF, "windows-1252")
