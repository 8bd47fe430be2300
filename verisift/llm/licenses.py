"""License scans by ordered signature rules, in DataFrame functions only.

RULES is an ordered list of hand-written signatures: label, keyword, pattern.  A document takes part if it
has a word that begins with one of GATE; a rule is tried on it only if it holds that rule's own keyword.  Every match is an interval of
characters with its rule's priority (its place in the list).  An interval that another one contains is
suppressed; of two equal intervals the rule of higher priority stays.  The labels of what stays are the
method's own (`method_labels`).  Base labels (see BASE) are found by places of words and never suppressed.

Patterns are matched on the text with A-Z lower-cased; \\s+ stands for any white space, so that lines may break anywhere.
Null texts count as empty, a very long text is scanned whole in its row.  Rows that share a doc_id are kept apart; an empty table gives
no rows; columns of other names are carried by `scan`, those it makes are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base phrases (two or three words) and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: A word of the text as it stands; with A-Z lower-cased it is the same span.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What stands between two words.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Ends of a version number: no further digit, no dot and digit.
_END = r"(?![\d])(?!\.\d)"
_VERSION = r"(?:,?\s*(?:version|v\.?|ver\.?))?\s*"


def _family(label: str, keyword: str, name: str, versions: str, version: str = _VERSION) -> list[tuple[str, str, str]]:
    """Rules of one license by version, the version's dot and zeros as people write them, and last without any."""
    rules = [(f"{label}-{v}", keyword, rf"{name}{version}{v.removesuffix('.0').replace('.', chr(92) + '.')}{'(?:' + chr(92) + '.0)?' if v.endswith('.0') else ''}{_END}") for v in versions.split()]
    return [*rules, (label, keyword, name)]


def _spdx(names: str) -> list[tuple[str, str, str]]:
    """Rules of SPDX tags: the identifier after the tag's name."""
    return [(x.lower(), "spdx", rf"spdx-license-identifier:\s*\(?{x.lower().replace('.', chr(92) + '.').replace('+', chr(92) + '+')}(?![\w.+-])") for x in names.split()]


# Signatures in order of priority: identifiers, full names with versions, grants, notices, bare names.
RULES: list[tuple[str, str, str]] = [
    *_spdx(
        "MIT MIT-0 Apache-1.0 Apache-1.1 Apache-2.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause 0BSD ISC Zlib Unlicense WTFPL CC0-1.0 BSL-1.0 PostgreSQL NCSA X11 Python-2.0 PSF-2.0 "
        "GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
        "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-1.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 EUPL-1.1 EUPL-1.2 Artistic-1.0 Artistic-2.0 OFL-1.1 MS-PL MS-RL SSPL-1.0 BUSL-1.1 Elastic-2.0 AFL-3.0 OSL-3.0 "
        "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 ODbL-1.0 ODC-By-1.0 PDDL-1.0 GFDL-1.2-only GFDL-1.3-only JSON Ruby PHP-3.01 Zend-2.0 Vim"
    ),
    # Creative Commons, short and long names.
    *_family("cc-by-nc-nd", "by-nc-nd", r"\bcc[\s-]+by-nc-nd", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by-nc-sa", "by-nc-sa", r"\bcc[\s-]+by-nc-sa", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by-nc", "by-nc", r"\bcc[\s-]+by-nc", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by-nd", "by-nd", r"\bcc[\s-]+by-nd", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by-sa", "by-sa", r"\bcc[\s-]+by-sa", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by", "cc", r"\bcc[\s-]+by", "1.0 2.0 2.5 3.0 4.0", r"[\s-]+"),
    *_family("cc-by-nc-nd", "creative", r"creative\s+commons\s+attribution[\s-]+noncommercial[\s-]+noderiv(?:ative)?s", "2.0 2.5 3.0 4.0", r"\s+(?:international|unported|generic)?\s*"),
    *_family("cc-by-nc-sa", "creative", r"creative\s+commons\s+attribution[\s-]+noncommercial[\s-]+sharealike", "2.0 2.5 3.0 4.0", r"\s+(?:international|unported|generic)?\s*"),
    *_family("cc-by-nc", "creative", r"creative\s+commons\s+attribution[\s-]+non-?commercial", "2.0 2.5 3.0 4.0", r"\s+(?:international|unported|generic)?\s*"),
    *_family("cc-by-sa", "creative", r"creative\s+commons\s+attribution[\s-]+share\s?alike", "2.0 2.5 3.0 4.0", r"\s+(?:international|unported|generic)?\s*"),
    *_family("cc-by", "creative", r"creative\s+commons\s+attribution", "2.0 2.5 3.0 4.0", r"\s+(?:international|unported|generic)?\s*"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[\s-]+1\.0)?\b"),
    ("cc0-1.0", "creative", r"creative\s+commons\s+(?:cc0|zero)(?:\s+1\.0)?(?:\s+universal)?"),
    ("cc", "creativecommons", r"creativecommons\.org/licenses/[a-z-]+/\d\.\d"),
    ("cc0-1.0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0"),
    # GNU licenses, more specific names first.
    *_family("agpl", "affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", "1.0 3.0"),
    *_family("lgpl", "lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e", "2.1 3.0"),
    *_family("lgpl", "library", r"(?:gnu\s+)?library\s+general\s+public\s+licen[cs]e", "2.0"),
    *_family("gpl", "general", r"(?:gnu\s+)?general\s+public\s+licen[cs]e", "1.0 2.0 3.0"),
    *_family("gfdl", "documentation", r"gnu\s+free\s+documentation\s+licen[cs]e", "1.1 1.2 1.3"),
    *_family("agpl", "agpl", r"\b(?:gnu\s+)?agpl", "1.0 3.0", r"[\s,-]*v?\s*"),
    *_family("lgpl", "lgpl", r"\b(?:gnu\s+)?lgpl", "2.0 2.1 3.0", r"[\s,-]*v?\s*"),
    *_family("gpl", "gpl", r"\b(?:gnu\s+)?gpl", "1.0 2.0 3.0", r"[\s,-]*v?\s*"),
    ("gpl-or-later", "later", r"(?:either\s+)?version\s+\d(?:\.\d)?\s+of\s+the\s+licen[cs]e,?\s+or\s+\(?at\s+your\s+option\)?\s+any\s+later\s+version"),
    ("gnu", "gnu.org", r"gnu\.org/licen[cs]es/[a-z0-9.-]*"),
    # Apache, Mozilla, Eclipse, CDDL, European Union, Artistic, fonts, academic.
    *_family("apache", "apache", r"\b(?:the\s+)?apache\s+(?:software\s+)?licen[cs]e", "1.0 1.1 2.0"),
    *_family("apache", "apache", r"\bapache", "1.0 1.1 2.0", r"[\s-]+v?")[:-1],
    ("apache-2.0", "apache.org", r"apache\.org/licenses/license-2\.0"),
    *_family("mpl", "mozilla", r"mozilla\s+public\s+licen[cs]e", "1.0 1.1 2.0"),
    *_family("mpl", "mpl", r"\bmpl", "1.0 1.1 2.0", r"[\s-]+v?")[:-1],
    *_family("epl", "eclipse", r"eclipse\s+public\s+licen[cs]e", "1.0 2.0"),
    *_family("epl", "epl", r"\bepl", "1.0 2.0", r"[\s-]+v?")[:-1],
    *_family("cddl", "development", r"common\s+development\s+and\s+distribution\s+licen[cs]e(?:\s+\(cddl\))?", "1.0 1.1"),
    *_family("cddl", "cddl", r"\bcddl", "1.0 1.1", r"[\s-]+v?"),
    *_family("cpl", "common", r"common\s+public\s+licen[cs]e", "0.5 1.0"),
    *_family("eupl", "european", r"european\s+union\s+public\s+licen[cs]e", "1.0 1.1 1.2"),
    *_family("eupl", "eupl", r"\beupl", "1.0 1.1 1.2", r"[\s-]+v?"),
    *_family("artistic", "artistic", r"artistic\s+licen[cs]e", "1.0 2.0"),
    *_family("ofl", "font", r"(?:sil\s+)?open\s+font\s+licen[cs]e", "1.0 1.1"),
    *_family("afl", "academic", r"academic\s+free\s+licen[cs]e", "1.1 1.2 2.0 2.1 3.0"),
    *_family("osl", "open", r"open\s+software\s+licen[cs]e", "1.0 2.0 2.1 3.0"),
    *_family("bsl", "boost", r"boost\s+software\s+licen[cs]e", "1.0"),
    *_family("busl", "business", r"business\s+source\s+licen[cs]e", "1.0 1.1"),
    *_family("sspl", "server", r"server\s+side\s+public\s+licen[cs]e", "1.0"),
    *_family("elastic", "elastic", r"elastic\s+licen[cs]e", "1.0 2.0"),
    *_family("odbl", "database", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", "1.0"),
    *_family("odc-by", "commons", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", "1.0"),
    *_family("pddl", "dedication", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", "1.0"),
    *_family("psf", "python", r"python(?:\s+software\s+foundation)?\s+licen[cs]e", "2.0"),
    *_family("php", "php", r"\bphp\s+licen[cs]e", "3.0 3.01"),
    *_family("zpl", "zope", r"zope\s+public\s+licen[cs]e", "1.1 2.0 2.1"),
    *_family("lppl", "latex", r"latex\s+project\s+public\s+licen[cs]e", "1.0 1.1 1.2 1.3"),
    *_family("qpl", "public", r"\bq\s+public\s+licen[cs]e", "1.0"),
    *_family("ms-pl", "microsoft", r"microsoft\s+public\s+licen[cs]e", "1.0"),
    *_family("ms-rl", "microsoft", r"microsoft\s+reciprocal\s+licen[cs]e", "1.0"),
    *_family("ecl", "educational", r"educational\s+community\s+licen[cs]e", "1.0 2.0"),
    *_family("openrail", "openrail", r"(?:creativeml\s+)?openrail(?:-m|\+\+-m)?", "1.0", r"[\s-]*"),
    *_family("openrail", "rail", r"(?:creativeml\s+)?open\srail(?:-m|\+\+-m)?", "1.0", r"[\s-]*"),
    # BSD and MIT, names and grants.
    ("bsd-4-clause", "bsd", r"(?:original|old|4-clause|four-clause)[\s,-]+bsd|bsd[\s-]+(?:4-clause|4\s+clause|old)"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3-clause|three-clause)[\s,-]+bsd|bsd[\s-]+(?:3-clause|3\s+clause|new)"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause|two-clause)[\s,-]+bsd|bsd[\s-]+(?:2-clause|2\s+clause)"),
    ("0bsd", "bsd", r"\b0bsd\b|zero-clause\s+bsd"),
    ("bsd", "bsd", r"\bbsd(?:-style)?\s+licen[cs]ed?\b"),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,?\s+with\s+or\s+without\s+modification"),
    ("bsd-3-clause", "endorse", r"may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software"),
    ("bsd-4-clause", "advertising", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software"),
    ("mit", "mit", r"\b(?:the\s+)?mit(?:/x11|-style)?\s+licen[cs]ed?\b"),
    ("mit", "expat", r"\b(?:the\s+)?expat(?:/x11|-style)?\s+licen[cs]ed?\b"),
    ("mit-0", "mit-0", r"\bmit-0\b"),
    ("mit-0", "attribution", r"\bmit\s+no\s+attribution\b"),
    ("mit", "permission", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    ("isc", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose"),
    ("x11", "x11", r"\bx11\s+licen[cs]e\b"),
    ("isc", "isc", r"\bisc\s+licen[cs]e\b"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)?\s+licen[cs]e\b"),
    ("zlib", "as-is", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    ("unlicense", "unlicense", r"\bunlicense\b|\bunlicense\.org\b"),
    ("unlicense", "unencumbered", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("wtfpl", "what", r"do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university\s+of\s+illinois/)?ncsa\s+open\s+source\s+licen[cs]e"),
    ("postgresql", "postgresql", r"\bpostgresql\s+licen[cs]e\b"),
    ("openssl", "openssl", r"\bopenssl\s+licen[cs]e\b"),
    ("ruby", "ruby", r"\bruby(?:'s)?\s+licen[cs]e\b"),
    ("vim", "vim", r"\bvim\s+licen[cs]e\b"),
    ("json", "evil", r"the\s+software\s+shall\s+be\s+used\s+for\s+good,?\s+not\s+evil"),
    ("beerware", "beer", r"\bbeer-?ware\b|buy\s+me\s+a\s+beer\s+in\s+return"),
    ("curl", "curl", r"\bcurl\s+licen[cs]e\b"),
    ("bzip2", "bzip2", r"\bbzip2\s+licen[cs]e\b"),
    ("libpng", "libpng", r"\blibpng\s+licen[cs]e\b"),
    ("tcl", "tcl", r"\btcl(?:/tk)?\s+licen[cs]e\b"),
    ("unicode", "unicode", r"\bunicode\s+(?:terms\s+of\s+use|licen[cs]e)\b"),
    ("w3c", "w3c", r"\bw3c\s+(?:software\s+(?:notice\s+and\s+)?)?licen[cs]e\b"),
    ("llama", "llama", r"\bllama\s*\d?(?:\.\d)?\s+community\s+licen[cs]e\b"),
    # Grants, conditions and disclaimers by their own words.
    ("mit", "substantial", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies\s+or\s+substantial\s+portions"),
    ("mit-modern", "permission", r"permission\s+is\s+hereby\s+granted,\s+without\s+written\s+agreement\s+and\s+without\s+license\s+or\s+royalty\s+fees"),
    ("mit-cmu", "permission", r"permission\s+to\s+use,\s+copy,\s+modify\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose\s+and\s+without\s+fee"),
    ("hpnd", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+(?:and\s+)?distribute,?\s+and\s+sell\s+this\s+software\s+and\s+its\s+documentation"),
    ("apache-2.0", "apache", r"licensed\s+under\s+the\s+apache\s+license,\s+version\s+2\.0\s+\(the\s+.?license.?\)"),
    ("apache-2.0", "compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license"),
    ("apache-2.0", "perpetual", r"perpetual,\s+worldwide,\s+non-exclusive,\s+no-charge,\s+royalty-free,\s+irrevocable\s+copyright\s+license"),
    ("apache-1.1", "jakarta", r"the\s+names\s+.?the\s+jakarta\s+project.?"),
    ("apache-1.0", "credit", r"this\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+group\s+for\s+use\s+in\s+the\s+apache\s+http\s+server\s+project.{0,40}credit"),
    ("gpl", "redistribute", r"this\s+program\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl", "redistribute", r"this\s+library\s+is\s+free\s+software[;:]\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify"),
    ("gpl", "merchantability", r"without\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability\s+or\s+fitness\s+for\s+a\s+particular\s+purpose"),
    ("gpl-classpath", "classpath", r"classpath\s+exception"),
    ("gpl-linking", "linking", r"linking\s+(?:this\s+library|exception)\s+(?:statically\s+or\s+dynamically\s+)?with\s+other\s+modules"),
    ("gcc-exception", "runtime", r"gcc\s+runtime\s+library\s+exception"),
    ("linux-syscall-note", "syscall", r"(?:linux-syscall-note|normal\s+syscalls?\s+is\s+not\s+covered)"),
    ("font-exception", "embed", r"if\s+you\s+create\s+a\s+document\s+which\s+uses\s+this\s+font,\s+and\s+embed\s+this\s+font"),
    ("bison-exception", "bison", r"special\s+exception\s(?:.{0,60}\s)?bison"),
    ("autoconf-exception", "autoconf", r"configure\s+scripts?\s+(?:that\s+(?:is|are)\s+)?(?:generated|output)\s+(?:by\s+)?(?:of\s+)?autoconf"),
    ("openssl-exception", "openssl", r"permission\s+to\s+link\s+(?:the\s+code\s+of\s+)?(?:portions\s+of\s+)?this\s+program\s+with\s+the\s+openssl\s+library"),
    ("llvm-exception", "llvm", r"\bllvm[\s-]+exceptions?\b"),
    ("agpl", "interacting", r"all\s+users\s+interacting\s+with\s+it\s+remotely\s+through\s+a\s+computer\s+network"),
    ("mpl-2.0", "exhibit", r"exhibit\s+a\s+-\s+source\s+code\s+form\s+license\s+notice"),
    ("mpl-2.0", "mozilla", r"subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license,\s+v\.\s+2\.0"),
    ("mpl-1.1", "npl", r"\bnpl/gpl/lgpl\b|\bmpl/gpl/lgpl\s+\(npl\)"),
    ("epl", "eclipse.org", r"eclipse\.org/legal/epl-v\d"),
    ("cddl", "opensolaris", r"opensolaris\.license|opensolaris\.org/os/licensing"),
    ("bsd-3-clause", "contributors", r"neither\s+the\s+names?\s+of\s+(?:the\s+)?\S+(?:\s+\S+){0,8}\s+nor\s+the\s+names\s+of\s+(?:its|their)\s+contributors"),
    ("bsd-2-clause", "retain", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice"),
    ("bsd-2-clause", "reproduce", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice"),
    ("bsd-disclaimer", "provided", r"provided\s+by\s+the\s+(?:copyright\s+holders(?:\s+and\s+contributors)?|regents(?:\s+and\s+contributors)?|authors?)\s+.{0,2}as\s+is"),
    ("bsd-4-clause-uc", "regents", r"the\s+regents\s+of\s+the\s+university\s+of\s+california"),
    ("bsd-patent", "patent", r"additional\s+grant\s+of\s+patent\s+rights"),
    ("bsd-nuclear", "nuclear", r"not\s+designed,\s+licensed\s+or\s+intended\s+for\s+use\s+in\s+the\s+design,\s+construction,\s+operation\s+or\s+maintenance\s+of\s+any\s+nuclear\s+facility"),
    ("isc", "copies", r"provided\s+that\s+the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+appear\s+in\s+all\s+copies"),
    ("0bsd", "granted", r"with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.\s+the\s+software\s+is\s+provided"),
    ("zlib", "misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented"),
    ("zlib", "altered", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such"),
    ("boost-1.0", "machine-executable", r"solely\s+in\s+the\s+form\s+of\s+machine-executable\s+object\s+code"),
    ("boost-1.0", "boost", r"boost\.org/license_1_0|\bboost\s+license\b"),
    ("cc0-1.0", "waive", r"waive[sd]?\s+all\s+(?:of\s+(?:his|her|their)\s+)?(?:copyright\s+and\s+related|rights)"),
    ("cc0-1.0", "copyright", r"\bno\s+copyright\s(?:.{0,40}\s)?rights\s+reserved\b"),
    ("unlicense", "compile", r"anyone\s+is\s+free\s+to\s+copy,\s+modify,\s+publish,\s+use,\s+compile,\s+sell"),
    ("wtfpl", "wtf", r"\bwtf\s+public\s+licen[cs]e\b"),
    ("cc-by-sa", "share-alike", r"attribution[\s-]+share-alike\s+licen[cs]e"),
    ("cc-by", "attribution", r"\battribution\s+\d\.0\s+(?:international|unported|generic)\b"),
    ("cc-by-nc", "noncommercial", r"\battribution-noncommercial\s+\d\.0\b"),
    ("cc-sampling", "sampling", r"\bsampling\s+plus\s+\d\.\d\b"),
    ("cc", "creative", r"\bcreative\s+commons\s+licen[cs]e[ds]?\b"),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by"),
    ("pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl"),
    ("ogl-uk", "government", r"\bopen\s+government\s+licen[cs]e\b"),
    ("ogl-canada", "canada", r"open\s+government\s+licen[cs]e\s+-\s+canada"),
    ("etalab", "etalab", r"\betalab\b|\blicence\s+ouverte\s+/\s+etalab\b"),
    ("dl-de-by", "datenlizenz", r"datenlizenz\s+deutschland(?:\s+[-–]\s+namensnennung)?"),
    ("nlod", "norwegian", r"norwegian\s+licen[cs]e\s+for\s+open\s+government\s+data"),
    ("cdla-permissive", "permissive", r"community\s+data\s+license\s+agreement\s+[-–]\s+permissive"),
    ("cdla-sharing", "sharing", r"community\s+data\s+license\s+agreement\s+[-–]\s+sharing"),
    ("lgpl-lr", "linguistic", r"lesser\s+general\s+public\s+license\s+for\s+linguistic\s+resources"),
    ("free-art", "art", r"\bfree\s+art\s+licen[cs]e\b"),
    ("free-art", "libre", r"\blicence\s+art\s+libre\b"),
    ("cern-ohl", "cern", r"\bcern[\s-]+(?:open\s+hardware\s+licen[cs]e|ohl)\b"),
    ("tapr-ohl", "tapr", r"\btapr\s+open\s+hardware\s+licen[cs]e\b"),
    ("solderpad", "solderpad", r"\bsolderpad\s+(?:hardware\s+)?licen[cs]e\b"),
    ("ofl", "reserved", r"\breserved\s+font\s+names?\b"),
    ("ubuntu-font", "ubuntu", r"\bubuntu\s+font\s+licen[cs]e\b"),
    ("bitstream-vera", "bitstream", r"\bbitstream\s+vera\s(?:.{0,40}\s)?trademark\b"),
    ("gust-font", "gust", r"\bgust\s+font\s+licen[cs]e\b"),
    ("ipa-font", "ipa", r"\bipa\s+font\s+licen[cs]e\b"),
    ("arphic", "arphic", r"\barphic\s+public\s+licen[cs]e\b"),
    ("openldap", "openldap", r"\bopenldap\s+public\s+licen[cs]e\b"),
    ("xfree86", "xfree86", r"\bxfree86\s+(?:project\s+)?licen[cs]e\b"),
    ("net-snmp", "snmp", r"\bnet-snmp\s+licen[cs]e\b"),
    ("ntp", "ntp", r"\bntp\s+licen[cs]e\b"),
    ("sleepycat", "sleepycat", r"\bsleepycat\s+(?:public\s+)?licen[cs]e\b"),
    ("sendmail", "sendmail", r"\bsendmail\s+licen[cs]e\b"),
    ("jpeg-group", "jpeg", r"based\s+in\s+part\s+on\s+the\s+work\s+of\s+the\s+independent\s+jpeg\s+group"),
    ("libtiff", "libtiff", r"\blibtiff\s+licen[cs]e\b|\bsam\s+leffler\s(?:.{0,60}\s)?libtiff\b"),
    ("freetype", "freetype", r"\bfreetype\s+(?:project\s+)?licen[cs]e\b"),
    ("icu", "icu", r"\bicu\s+licen[cs]e\b"),
    ("unicode", "unicode.org", r"unicode\.org/(?:copyright|license)"),
    ("imagemagick", "imagemagick", r"\bimagemagick\s+licen[cs]e\b"),
    ("perl", "perl", r"same\s+terms\s+as\s+perl(?:\s+itself)?"),
    ("python-cnri", "cnri", r"\bcnri\s+(?:open\s+source\s+)?(?:gpl-compatible\s+)?licen[cs]e\b"),
    ("ruby", "ruby", r"same\s+terms\s+as\s+ruby(?:\s+itself)?"),
    ("php", "php.net", r"php\.net/license"),
    ("tcl", "scriptics", r"scriptics\s+corporation.{0,60}permission"),
    ("clisp", "clisp", r"\bclisp\s+licen[cs]e\b"),
    ("erlang", "erlang", r"\berlang\s+public\s+licen[cs]e\b"),
    ("latex", "lppl", r"\blppl\b(?:[\s-]+(?:version\s+)?1\.\d[a-c]?)?"),
    ("intel-open", "intel", r"\bintel\s+open\s+source\s+licen[cs]e\b"),
    ("ibm-pl", "ibm", r"\bibm\s+public\s+licen[cs]e\b"),
    ("nokia", "nokia", r"\bnokia\s+open\s+source\s+licen[cs]e\b"),
    ("apple-psl", "apple", r"\bapple\s+public\s+source\s+licen[cs]e\b"),
    ("apple-sample", "apple", r"apple\s+grants\s+you\s+a\s+personal,\s+non-exclusive\s+license"),
    ("sun-pl", "sun", r"\bsun\s+(?:industry\s+standards\s+source|public)\s+licen[cs]e\b"),
    ("oracle-bcl", "oracle", r"\boracle\s+binary\s+code\s+licen[cs]e\b"),
    ("oracle-upl", "universal", r"\buniversal\s+permissive\s+licen[cs]e\b"),
    ("nasa", "nasa", r"\bnasa\s+open\s+source\s+agreement\b"),
    ("rpl", "reciprocal", r"\breciprocal\s+public\s+licen[cs]e\b"),
    ("cpal", "attribution", r"\bcommon\s+public\s+attribution\s+licen[cs]e\b"),
    ("hippocratic", "hippocratic", r"\bhippocratic\s+licen[cs]e\b"),
    ("anti-996", "996", r"\banti[\s-]+996\s+licen[cs]e\b"),
    ("commons-clause", "clause", r"\bcommons\s+clause\b"),
    ("polyform", "polyform", r"\bpolyform\s+(?:noncommercial|small\s+business|shield|perimeter|strict|free\s+trial|internal\s+use)\s+licen[cs]e\b"),
    ("confluent", "confluent", r"\bconfluent\s+community\s+licen[cs]e\b"),
    ("timescale", "timescale", r"\btimescale\s+licen[cs]e\b"),
    ("redis-sal", "redis", r"\bredis\s+source\s+available\s+licen[cs]e\b"),
    ("fsl", "functional", r"\bfunctional\s+source\s+licen[cs]e\b"),
    ("parity", "parity", r"\bparity\s+public\s+licen[cs]e\b"),
    ("blue-oak", "oak", r"\bblue\s+oak\s+model\s+licen[cs]e\b"),
    ("mulan", "mulan", r"\bmulan\s+(?:psl|permissive\s+software\s+licen[cs]e|public\s+licen[cs]e)\b"),
    ("cecill", "cecill", r"\bcecill(?:-[abc])?\b"),
    ("liliq", "liliq", r"\bliliq-(?:p|r|rplus)\b"),
    ("upstream-ai", "gemma", r"\bgemma\s+terms\s+of\s+use\b"),
    ("bigcode", "bigcode", r"\bbigcode\s+openrail(?:-m)?\b"),
    ("research-only", "research", r"for\s+(?:non-?commercial\s+)?research\s+(?:and\s+educational\s+)?purposes\s+only"),
    ("non-commercial", "commercial", r"for\s+non-?commercial\s+(?:use|purposes)\s+only|not\s+for\s+commercial\s+use"),
    ("personal-use", "personal", r"for\s+(?:your\s+)?personal(?:,\s+non-?commercial)?\s+use\s+only"),
    ("evaluation-only", "evaluation", r"for\s+evaluation\s+purposes\s+only"),
    ("no-derivatives", "derivative", r"may\s+not\s+(?:create|make|distribute)\s+derivative\s+works"),
    ("eula", "user", r"\bend\s+user\s+licen[cs]e\s+agreement\b"),
    ("trial", "trial", r"\btrial\s+licen[cs]e\b"),
    ("freeware", "freeware", r"\bfreeware\b"),
    ("shareware", "shareware", r"\bshareware\b"),
    ("crown-copyright", "crown", r"\bcrown\s+copyright\b"),
    ("us-government", "government", r"work\s+of\s+the\s+(?:united\s+states|u\.s\.)\s+government"),
    ("copyleft", "copyleft", r"\bcopyleft\b"),
    ("permission-required", "permission", r"(?:prior\s+)?written\s+permission\s+(?:of|from)\s+the\s+(?:publisher|author|copyright\s+holder)"),
    ("reproduction-prohibited", "prohibited", r"(?:reproduction|redistribution|unauthori[sz]ed\s+(?:use|copying))\s+(?:\S+\s+){0,6}(?:is\s+)?(?:strictly\s+)?prohibited"),
    ("no-reproduction", "reproduced", r"no\s+part\s+of\s+this\s+(?:publication|book|document|work)\s+may\s+be\s+reproduced"),
    ("copyright-notice", "copyright", r"\bcopyright\s+(?:\(c\)|©)\s+\d{4}"),
    # Notices without a name.
    ("public-domain", "public", r"(?:in|into|to|dedicated\s+to)\s+the\s+public\s+domain"),
    ("proprietary", "proprietary", r"proprietary\s+and\s+confidential|proprietary\s+licen[cs]e"),
    ("all-rights-reserved", "reserved", r"\ball\s+rights\s+reserved\b"),
    ("commercial", "commercial", r"\bcommercial\s+licen[cs]e\b"),
    ("dual", "dual", r"\bdual[\s-]+licen[cs]ed\b"),
    ("unknown-license", "licen", r"(?:released|licen[cs]ed|distributed|available|published)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?[^\s.,;]+(?:\s+[^\s.,;]+){0,4}\s+licen[cs]e\b"),
]
_GROUP = re.compile(r"(?<!\\)\((?:[^()\\]|\\.)*\)[?*]?")


def _needs_licen(pattern: str) -> bool:
    """Whether no match is without "licen" at a word's start: it stands outside all groups and alternatives."""
    while (outer := _GROUP.sub("a", pattern)) != pattern:
        pattern = outer
    return "|" not in pattern and bool(re.search(r"(?<![a-z])licen", pattern))


#: A document takes part if one of these begins a word of it.  A pattern that cannot match without "licen" at a word's start needs no other.
GATE = sorted({"licen"} | {k for _, k, p in RULES if not _needs_licen(p)} | {"0bsd"})


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rules() -> Column:
    return F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(pattern).alias("pattern")) for k, (label, keyword, pattern) in enumerate(RULES)])


def _intervals(rule: Column) -> Column:
    """All matches of one rule: what stands between them and their own lengths give their places."""
    found = F.regexp_extract_all("_low", rule["pattern"], F.lit(0))
    parts = F.zip_with(F.slice(F.split("_low", rule["pattern"]), F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size")))
    none = F.array().cast("array<struct<start:int,stop:int,priority:int,label:string>>")
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop"), rule["priority"].alias("priority"), rule["label"].alias("label")))).alias("out")),
    )
    return walk["out"]


def _phrase(words: list[str]) -> Column:
    """Whether a phrase starts at word i of _words."""
    return lambda i: F.expr("true") if not words else _all([F.element_at("_words", (i + k + 1).cast("int")) == w for k, w in enumerate(words)])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, method_labels, labels, n_detections, score."""
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "method_labels", "labels", "n_detections", "score"]
    carried = [c for c in docs.columns if c not in made]
    text = F.coalesce("text", F.lit(""))
    ends = "|".join(sorted({f"{a}{GAP}{b}" for *_, a, b in (p.split(" ") for p, _ in BASE)}))
    gated = docs.select(
        *carried,
        F.split(text, GAP).alias("_parts"),
        F.when(text.rlike(rf"(?i)\b(?:{_either(GATE)})"), lower_ascii(text)).alias("_low"),
        text.rlike(f"(?i)(?:{ends})").alias("_base"),
    )
    # What stands between the gaps are the words, but for nothing before a first and after a last gap.
    n_parts = F.size("_parts")
    n_words = n_parts - (F.element_at("_parts", 1) == "").cast("int") - ((n_parts > 1) & (F.element_at("_parts", -1) == "")).cast("int")
    gated = gated.withColumn("n_words", n_words.cast("long")).drop("_parts")
    split = gated.withColumn("_words", F.when(F.col("_base"), F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))))
    places = split
    for k, (phrase, _) in enumerate(BASE):
        own = phrase.split(" ")
        last = F.size("_words") - len(own)
        here = F.when(F.col("_base") & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), _phrase(own)))
        places = places.withColumn(f"_at{k}", F.coalesce(here, F.array().cast("array<int>")))
    every = F.concat(*[F.col(f"_at{k}") for k in range(len(BASE))])
    based = places.select(*carried, "n_words", "_low", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_compact(F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)])).alias("_base_labels"))
    # Each keyword is looked for once, however many rules have it.
    known = F.array(*[F.lit(k) for k in sorted({k for _, k, _ in RULES})])
    based = based.withColumn("_known", F.when(F.col("_low").isNotNull(), F.filter(known, lambda k: F.contains("_low", k))))
    tried = F.filter(_rules(), lambda r: F.array_contains("_known", r["keyword"]))
    hits = based.withColumn("_hits", F.when(F.size("_known") > 0, F.flatten(F.transform(tried, _intervals))))
    # Sorted by start, longest first, then priority: contained is what ends no later than anything before it.
    order = F.transform("_hits", lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("left"), x["priority"].alias("priority"), x["label"].alias("label")))
    nothing = F.struct(F.lit(-1).alias("stop"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("n"))
    kept = F.aggregate(
        F.array_sort(order),
        nothing,
        lambda acc, x: F.struct(F.greatest(acc["stop"], -x["left"]).alias("stop"), F.when(-x["left"] > acc["stop"], F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"), (acc["n"] + F.when(-x["left"] > acc["stop"], 1).otherwise(0)).alias("n")),
    )
    kept = hits.withColumn("_kept", F.coalesce(F.when(F.col("_hits").isNotNull(), kept), nothing))
    n = F.col("_kept.n") + F.col("n_base")
    return kept.select(
        *carried, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("_base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort("_kept.labels"), ",").alias("method_labels"),
        F.array_join(F.array_sort(F.array_union("_base_labels", "_kept.labels")), ",").alias("labels"),
        F.col("_kept.n").cast("long").alias("n_detections"),
        (n / (n + 1)).alias("score"),
    )


def _either(words: list[str]) -> str:
    """A pattern of what begins with any of the words, each beginning that they share written once."""
    if "" in words:
        return ""
    tails = {c: [w[1:] for w in words if w[0] == c] for c in sorted({w[0] for w in words})}
    parts = [_literal(c) + _either(rest) for c, rest in tails.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _literal(word: str) -> str:
    return re.sub(r"([.+-])", r"\\\1", word)
