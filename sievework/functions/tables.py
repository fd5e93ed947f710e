"""Lists, signatures, limits and orders that the inspection works by."""

CATEGORIES = {"profile": [".jpg", ".jpeg", ".png", ".webp", ".svg"], "id": [".pdf", ".jpg", ".jpeg", ".png"]}

#: Type: (offset, bytes in hex), all of which must match. Types are tried in this order.
SIGNATURES = {
    "jpeg": [(0, "FFD8FF")],
    "pdf": [(0, "25504446")],
    "png": [(0, "89504E470D0A1A0A")],
    "webp": [(0, "52494646"), (8, "57454250")],
}

#: What else a file may be, by its first bytes; the first that matches counts.
FOREIGN = [
    ("OLE / legacy Office (CFB)", "D0CF11E0A1B11AE1"),
    ("RAR archive", "526172211A07"),
    ("7-Zip archive", "377ABCAF271C"),
    ("RTF document", "7B5C727466"),
    ("ELF executable", "7F454C46"),
    ("Java class file", "CAFEBABE"),
    ("ZIP archive (or JAR / OOXML)", "504B0304"),
    ("ZIP archive (empty or spanned)", "504B0506"),
    ("GIF image", "47494638"),
    ("TIFF image (little-endian)", "49492A00"),
    ("TIFF image (big-endian)", "4D4D002A"),
    ("Windows icon", "00000100"),
    ("WebAssembly module", "0061736D"),
    ("PostScript", "25215053"),
    ("Microsoft Cabinet", "4D534346"),
    ("Flash (uncompressed)", "465753"),
    ("Flash (compressed)", "435753"),
    ("Windows executable (MZ / PE)", "4D5A"),
    ("gzip stream", "1F8B"),
    ("BMP image", "424D"),
    ("Shell script (shebang)", "2321"),
]
FOREIGN_TEXT = [("PHP source", "<?php"), ("PHP short-open source", "<?="), ("HTML document", "<!doctype html"), ("HTML document", "<html"), ("XML document (non-SVG)", "<?xml"), ("Windows batch script", "@echo off")]

#: Detected type: accepted content types, the first of which is the canonical one.
CONTENT_TYPES = {"jpeg": ["image/jpeg", "image/jpg"], "png": ["image/png"], "webp": ["image/webp"], "svg": ["image/svg+xml"], "pdf": ["application/pdf"]}
EXTENSION_TYPES = {"jpg": "jpeg", "jpeg": "jpeg", "png": "png", "webp": "webp", "svg": "svg", "pdf": "pdf"}
DECLARED_BY_EXTENSION = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml", ".webp": "image/webp", ".pdf": "application/pdf"}

DANGEROUS_EXTENSIONS = (
    "php php2 php3 php4 php5 php7 php8 phtml pht phar phps inc "
    "asp aspx asa asax ascx ashx asmx cer cshtml vbhtml config "
    "jsp jspx jsw jsv jspf jar war ear "
    "exe dll com msi msp scr pif cpl msc "
    "bat cmd ps1 psm1 ps1xml vbs vbe js jse wsf wsh hta chm lnk reg url "
    "sh bash zsh ksh csh py pyc pl rb cgi lua "
    "htaccess htpasswd user ini "
    "svg html htm xhtml shtml xml xsl swf"
).split()

SCHEMES = ["javascript", "vbscript", "livescript", "mocha", "file", "php", "jar"]
DATA_URIS = ["data:text/html", "data:application/", "data:image/svg"]
NAMESPACE_HOSTS = "www.w3.org ns.adobe.com purl.org iptc.org www.iptc.org www.aiim.org pdfa.org www.pdfa.org www.npes.org schemas.microsoft.com www.color.org iso.org www.iso.org crossmark.crossref.org www.prismstandard.org".split()
URL = r"https?://[^\s\x85\xA0\x22\x27<>)\]]+"
HOST = r"^(?i)https?://([^/:\s\x85\xA0]+)"

SVG_ELEMENTS = "svg g defs title desc path rect circle ellipse line polyline polygon text tspan linearGradient radialGradient stop clipPath mask pattern".split()
SVG_ATTRIBUTES = (
    "id class width height viewBox x y x1 y1 x2 y2 cx cy r rx ry d points transform "
    "fill fill-opacity fill-rule stroke stroke-width stroke-opacity stroke-linecap stroke-linejoin stroke-dasharray "
    "opacity offset stop-color stop-opacity font-family font-size font-weight text-anchor gradientUnits xmlns"
).split()
SVG_NOTABLE = "script foreignObject use image animate animateTransform set handler style iframe embed object a".split()

SEVERITIES = ["critical", "high", "medium", "low", "test", "info", "unknown"]
LAYERS = ["ExtensionWhitelist", "MagicBytes", "HeaderContentMatching", "DoubleExtension", "SignatureScanning", "PdfFlateDecode", "EmbeddedLink", "ImageReEncoding", "SvgSanitization"]
SCANNERS = ["DVWA-Low", "DVWA-Medium", "DVWA-High", "DVWA-Impossible", "BasicValidation", "StaticAnalysis"]

UPLOAD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".svg", ".pdf"]
UPLOAD_TYPES = ["image/jpeg", "image/png", "image/webp", "image/svg+xml", "application/pdf"]
UPLOAD_BYTES = 5 * 1024 * 1024
SMALL_BYTES, SMALL_EXTENSIONS, SMALL_TYPES = 100_000, ["jpg", "jpeg", "png"], ["image/jpeg", "image/png"]

PDF_DEPTH, PDF_STREAM_BYTES, PDF_TOTAL_BYTES, PDF_RATIO = 4, 10 << 20, 50 << 20, 1500
IMAGE_SIDE, IMAGE_PIXELS, JPEG_QUALITY = 10_000, 40_000_000, 90
CO_LOCATED = 512
