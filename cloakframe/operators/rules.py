"""The deterministic rule list: 65 identifier rules, plus names, addresses and dates.

A rule is data: a pattern in three parts (before, value, after; the span is the
value), a confidence, an optional check and a gate. The gate is a set of literal
substrings of which a matching text must contain at least one, so that a text
without them is skipped by a plain substring search instead of a regex pass.
``digit`` says that every match holds a digit; texts without any skip all such rules.
``signs`` are characters of which every match holds one, and ``caps`` says that it holds a
capital letter A-Z followed by another or by a digit; each is looked for once in a text.
``foreign`` says the same of non-Latin script.
``order`` is the position in the list and the last tie-break of arbitration.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- small helpers to spell patterns ---------------------------------------


def not_after(chars: str) -> str:
    return f"(?<![{chars}])"


def not_before(chars: str) -> str:
    return f"(?![{chars}])"


def words(*labels: str) -> str:
    """Alternatives; a blank inside a label stands for any run of white space."""
    return "(?:" + "|".join(label.replace(" ", r"\s+") for label in labels) + ")"


@dataclass(frozen=True)
class Rule:
    key: str
    type: str
    confidence: float
    value: str
    before: str = ""
    after: str = ""
    ignore_case: bool = False
    check: str | None = None
    validated: bool = False
    gate: tuple[str, ...] = ()
    gate_regex: str | None = None
    digit: bool = False
    foreign: bool = False
    signs: str = ""
    caps: bool = False
    post: tuple[str, ...] = ()
    sources: tuple[str, ...] = ("rules",)
    order: int = field(default=0)

    @property
    def flags(self) -> str:
        return "idU" if self.ignore_case else "dU"

    @property
    def java(self) -> str:
        return f"(?{self.flags})({self.before})({self.value})(?<tail>{self.after})"


ID = "A-Za-z0-9_-"
ALNUM = "A-Za-z0-9"
KEY_END = not_before(ID)


def _secret(key, value, gate, confidence=0.99, left=not_after(ID), right=KEY_END, **kw):
    return Rule(key, "SECRET", confidence, value, left, right, validated=True, gate=gate, **kw)


# Public token formats and identifier shapes.
_PEM = "(?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"
EXACT = (
    _secret("B3", rf"-----BEGIN {_PEM}[\s\S]+?-----END {_PEM}", ("PRIVATE KEY",), 1.0, "", ""),
    _secret("B4", "AIza[0-9A-Za-z_-]{35,38}", ("AIza",)),
    _secret("B5", "[sr]k_(?:live|test)_[0-9A-Za-z]{20,}", ("k_live_", "k_test_"), right=not_before(ALNUM)),
    _secret("B6", "cli_[a-z0-9]{16,}", ("cli_",), 0.98, right=not_before("a-z0-9")),
    _secret(
        "B7",
        "sk-(?:proj|svcacct|admin)-[A-Za-z0-9_-]{20,100}T3BlbkFJ[A-Za-z0-9_-]{20,100}",
        ("T3BlbkFJ",),
    ),
    _secret("B8", "sk-[A-Za-z0-9]{20}T3BlbkFJ[A-Za-z0-9]{20}", ("T3BlbkFJ",), right=not_before(ALNUM)),
    _secret("B9", "sk-ant-api03-[A-Za-z0-9_-]{93}AA", ("sk-ant-api03-",)),
    _secret("B10", "hf_[A-Za-z0-9]{34,40}", ("hf_",)),
    _secret("B11", "glpat-[0-9A-Za-z_-]{20}", ("glpat-",), 0.98),
    _secret("B12", r"dapi[a-f0-9]{32}(?:-\d)?", ("dapi",), 0.98),
    _secret("B13", "lin_api_[a-z0-9]{40}", ("lin_api_",), 0.98, right=not_before("a-z0-9")),
    _secret(
        "B14", "[A-Za-z0-9_~.-]{3}8Q~[A-Za-z0-9_~.-]{34}", ("8Q~",),
        left=not_after(r"A-Za-z0-9_~.\-"), right=not_before("A-Za-z0-9_~.-"),
    ),
    Rule(
        "B15", "DATABASE_URI", 0.998,
        r"(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqps?|mssql)://[^\s<>\"'，。；;]+",
        not_after(ALNUM) + "(?<!jdbc:)", ignore_case=True, validated=True, gate=("://",),
    ),
    Rule(
        "B16", "DATABASE_URI", 0.995,
        r"jdbc:(?:mysql\+srv|mysql|mariadb|postgresql|oracle|sqlserver)(?::[A-Za-z0-9_-]+)?:[^\s<>\"'，。；;]+",
        not_after(ALNUM), ignore_case=True, validated=True, gate=("jdbc:",),
    ),
    _secret("B17", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyJ",), check="jwt_header"),
    _secret(
        "B18", "github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}", ("github_pat_",),
        left=not_after("A-Za-z0-9_"), right=not_before("A-Za-z0-9_"),
    ),
    _secret("B19", "LTAI[0-9A-Za-z]{12,20}", ("LTAI",), 0.97, not_after(ALNUM), not_before(ALNUM)),
    _secret("B20", "(?:AKID|IKID)[0-9A-Za-z]{32}", ("KID",), 0.97, not_after(ALNUM), not_before(ALNUM)),
    _secret(
        "B21",
        "(?:A3T[A-Z0-9]|AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ABIA|ACCA)[A-Z0-9]{16}",
        ("A3T", "AKIA", "ASIA", "AGPA", "AIDA", "AROA", "AIPA", "ANPA", "ANVA", "ABIA", "ACCA"),
        left=not_after("A-Z0-9"), right=not_before("A-Z0-9"),
    ),
    _secret("B22", "ghs_[A-Za-z0-9._-]{36,}", ("ghs_",)),
    _secret(
        "B23", "(?:sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9_]{20,})",
        ("sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), left=not_after(ALNUM), right=not_before(ALNUM),
    ),
    _secret(
        "B24", "[A-Za-z0-9/+=]{40}", ("aws",), 0.98,
        r"aws[_-]?secret[_-]?access[_-]?key[\"']?\s*[:=]\s*[\"']?", not_before("A-Za-z0-9/+="), ignore_case=True,
    ),
    Rule(
        "B25", "SECRET", 0.95, "[A-Za-z0-9._~+/=-]{20,}", not_after(ALNUM) + r"Bearer\s+",
        "(?![A-Za-z0-9._~+/=-]*[A-Za-z])", ignore_case=True, gate=("bearer",),
    ),
    _secret(
        "B26", "(?:xox[brps]|xapp|xwfp)-[0-9A-Za-z-]{20,}", ("xox", "xapp-", "xwfp-"), 0.98,
        not_after(ALNUM), not_before(ALNUM),
    ),
    Rule(
        "B27", "IBAN", 0.995,
        r"[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4})?)",
        not_after(ALNUM), not_before(ALNUM), True, "iban", True,
        gate_regex=r"(?iU)[a-z]{2}\d{2}[ 0-9a-z][0-9a-z]{4}",
    ),
    Rule(
        "B28", "EMAIL", 0.99, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}",
        not_after("A-Za-z0-9._%+-"), r"(?![A-Za-z0-9]|\.[A-Za-z])", True, validated=True, gate=("@",),
        post=("uri_email",),
    ),
    Rule(
        "B29", "CN_ID_CARD", 0.995, r"(?:\d{17}[0-9Xx]|\d{15})", not_after("0-9A-Za-z"),
        not_before("0-9A-Za-z"), check="cn_id_card", validated=True, gate_regex=r"(?U)\d{15}",
    ),
    Rule(
        "B30", "CN_USCC", 0.995, r"[159Y][1239]\d{6}[0-9A-HJ-NPQRTUWXY]{10}", not_after("0-9A-Z"),
        not_before("0-9A-Z"), True, "cn_uscc", True, gate_regex=r"(?U)[1239]\d{6}",
    ),
    Rule(
        "B31", "PHONE", 0.985, r"\+\d{1,4}(?:[ -]?(?:\(\d{1,5}\)|\d{1,5})){1,5}", r"(?<![\w+])", r"(?!\d)",
        check="intl_phone", validated=True, gate_regex=r"(?U)\+\d",
    ),
    Rule(
        "B32", "IPV6_ADDRESS", 0.985, "(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", not_after("0-9A-Fa-f:"),
        not_before("0-9A-Fa-f:"), check="ipv6", validated=True, gate_regex=":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:",
    ),
    Rule(
        "B33", "US_SSN", 0.98, r"\d{3}-\d{2}-\d{4}", r"(?<!\d)", r"(?!\d)", validated=True,
        gate_regex=r"(?U)\d-\d{2}-\d",
    ),
    Rule(
        "B34", "CN_PHONE_NUMBER", 0.99, r"(?:(?:\+?86|0086)[ -]?)?1[3-9]\d(?:([ -])\d{4}\3\d{4}|\d{8})",
        r"(?<![\d+A-Za-z])", r"(?!\d)", check="cn_mobile", validated=True,
        gate_regex=r"(?U)1[3-9]\d[ -]?\d{4}", post=("foreign_prefix",),
    ),
    Rule(
        "B35", "CN_BANK_CARD", 0.97, r"(?:[3-6]\d{12,18}|[3-6]\d{2,5}(?:([ -])\d{1,6}){1,4})",
        r"(?<!\d)", r"(?!\d)", check="bank_card", validated=True, gate_regex=r"(?U)[3-6]\d{2}[ -]?\d",
    ),
    Rule(
        "B36", "CN_PASSPORT", 0.94, r"(?:[EG]\d{8}|[KJ]\d{7}|P\d{7}|S\d{7,8}|D\d{7,8})", not_after("A-Z0-9"),
        not_before("A-Z0-9"), True, validated=True, gate_regex=r"(?iU)[egkjpsd]\d{7}",
    ),
    Rule(
        "B37", "CN_LICENSE_PLATE", 0.95,
        r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][·•]?"
        r"(?=[A-HJ-NP-Z0-9]{0,5}\d)[A-HJ-NP-Z0-9]{5,6}",
        r"(?<![A-Z0-9一-鿿])", not_before("A-Z0-9"), validated=True, gate_regex=r"[一-鿿][A-Z]",
    ),
    Rule(
        "B38", "MAC_ADDRESS", 0.98, r"[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\3){4}[0-9A-Fa-f]{2}",
        not_after("0-9A-Fa-f:-"), not_before("0-9A-Fa-f:-"), check="mac", validated=True,
        gate_regex="[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]",
    ),
    Rule(
        "B39", "IP_ADDRESS", 0.95,
        r"(?:192\.168\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}"
        r"|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3})",
        not_after("0-9."), r"(?![0-9]|\.[0-9])", check="private_ipv4", validated=True,
        gate=("192.168.", "169.254.", "100."),
    ),
)

# Labels in front of a labelled value, per language.
_PW_KEYS = (
    "APP_PASSWORD", "DB_PASSWORD", "ADMIN_PASSWORD", "ROOT_PASSWORD",
    "Temporary Password", "temp password", "initial password", "admin password", "root password",
    "临时密码", "初始密码", "开机密码", "支付密码", "管理密码", "账户密码",
    "temporäres Passwort", "mot de passe temporaire", "contraseña temporal",
    "初期パスワード", "仮パスワード", r"임시\s*비밀번호", "كلمة المرور التجريبية", "รหัสผ่านชั่วคราว",
)
_PW_BARE = ("password", "passwd", "密码", "口令")
_PW_DELIM = (
    r"(?:[ \t]*[=＝][ \t]*|[ \t]*[:：][ \t]*(?:\r?\n[ \t]*)?"
    r"|[ \t]+(?:is|was|ist|lautet|est|es|为|是|هو|هي|คือ)[ \t]*)"
)
_SECRET_KEYS = (
    r"SSH\s*私钥标识", "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "GitHub token",
    "OpenAI-style test token", r"API\s*Token", "Temporary password", "OTP backup code", "recovery code",
    "登录密码", "密码", "口令", "passwd", "password", "secret", "token",
    "api[_ -]?key", "access[_ -]?key", "access[_ -]?token", "private[_ -]?key",
    "令牌", "密钥", "秘钥", "密匙", "凭据", "凭证", "私钥", "授权码", "访问密钥", "接口密钥",
    "パスワード", "비밀번호", "mot de passe", "Passwort", "Contraseña", "Пароль", "كلمة المرور", "รหัสผ่าน",
)
_SECRET_GATE = (
    "ssh", "aws", "token", "password", "otp", "recovery", "密码", "口令", "passwd", "secret",
    "key", "令牌", "密钥", "秘钥", "密匙", "凭据", "凭证", "私钥", "授权码",
    "パスワード", "비밀번호", "mot", "passwort", "contraseña", "пароль", "كلمة", "รหัสผ่าน",
)
_SECRET_CHARS = "A-Za-z0-9_!@#$%^&*_~+=-"
_SECRET_LOOK = (
    "(?!/)(?:(?=[A-Za-z0-9_!@#$%^&*_~+=-]*[0-9!@#$%^&*])|(?=[A-Za-z0-9_!@#$%^&*_~+=-]{16,}))"
)
_SECRET_VALUE = f"[A-Za-z0-9][{_SECRET_CHARS}]{{5,255}}"
_CN_PW = "登录密码|临时密码|用户密码|开机密码|支付密码|密码|口令"
_CN_KEYS = "令牌|密钥|秘钥|凭据|凭证|授权码|访问密钥|接口密钥|私钥"
_STATEMENTS = "(?:" + "|".join((
    r"(?<![“\"'\w])(?:(?:My|The)\s+)?(?:temporary\s+)?(?:password|passwd|secret|passcode)\s+(?:is|was)\s+"
    r"(?!not\b|a\b|the\b|an\b|only\b)",
    rf"(?:{_CN_PW})\s*(?:为|是)\s*",
    rf"(?:{_CN_KEYS})\s*(?:为|是)\s*",
    r"(?<![A-Za-z0-9_])(?:Passwort|Kennwort)\s+(?:ist|lautet)\s+",
    r"(?<![A-Za-z0-9_])mot\s+de\s+passe\s+est\s+",
    r"(?<![A-Za-z0-9_])contraseña\s+es\s+",
    r"(?<![぀-ヿ㐀-鿿])パスワード\s*は\s*",
    r"(?<![가-힯])비밀번호\s*(?:는|은)\s*",
    r"كلمة\s+المرور\s+(?:هو|هي)\s+",
    r"รหัสผ่าน\s*คือ\s*",
)) + ")"
_STATEMENT_GATE = (
    "password", "passwd", "secret", "passcode", "密码", "口令", "令牌", "密钥", "秘钥", "凭据", "凭证",
    "授权码", "私钥", "passwort", "kennwort", "mot", "contraseña", "パスワード", "비밀번호", "كلمة", "รหัสผ่าน",
)
_PHONE_KEYS = (
    r"手机号|备用电话|电话(?:号码)?|联系电话|電話番号|휴대전화\s*번호|전화번호|phone(?:\s+number)?|Telefonnummer"
    r"|numéro\s+de\s+téléphone|teléfono|номер\s+телефона|رقم\s+الهاتف|หมายเลขโทรศัพท์"
)
_PHONE_GATE = (
    "手机号", "电话", "電話番号", "휴대전화", "전화번호", "phone", "telefonnummer", "numéro", "teléfono",
    "номер", "رقم", "หมายเลขโทรศัพท์",
)
_COPULA = r"\s*(?:[=:：]|为|是|is|est|lautet|es|هو|คือ|は|는|은)?\s*"
_PASSPORT_KEYS = (
    r"(?:test[- ]?)?passport(?:\s+number)?|(?:Test[- ]?)?Passnummer|numéro\s+de\s+passeport(?:\s+de\s+test)?"
    r"|número\s+de\s+pasaporte(?:\s+de\s+prueba)?|номер\s+паспорта|جواز\s+السفر(?:\s+التجريبي)?"
    r"|หมายเลขหนังสือเดินทาง(?:ทดสอบ)?|パスポート番号|여권번호"
)
_MONTH, _DAY = "(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
_USER_KEYS = (
    "username", "user", "user name", "用户名", "公司账号", "登录ID", "ログインID", "계정 이름", "identifiant",
    "Benutzername", "Usuario", "Логин", "اسم المستخدم", "ชื่อผู้ใช้",
)
_USER_VALUE = r"(?:[一-鿿]{2,12}|[A-Za-z0-9][A-Za-z0-9_.-]{1,61}[A-Za-z0-9_]|[A-Za-z0-9]{2,63})"
_USER_STATEMENTS = "(?:" + "|".join((
    r"(?<![A-Za-z0-9_])(?:(?:My|The)\s+)?(?:username|user\s+name)\s+(?:is|was)\s+"
    r"(?!not\b|a\b|the\b|an\b|only\b)",
    r"(?:用户名|公司账号|登录账号|登录ID)\s*(?:为|是)\s*",
    r"(?<![A-Za-z0-9_])Benutzername\s+(?:ist|lautet)\s+",
    r"(?<![A-Za-z0-9_])Usuario\s+es\s+",
    r"(?<![A-Za-z0-9_])identifiant\s+est\s+",
    r"(?<![぀-ヿ㐀-鿿])ログインID\s*は\s*",
    r"(?<![가-힯])계정\s*이름\s*(?:은|는)\s*",
    r"اسم\s+المستخدم\s+هو\s+",
    r"ชื่อผู้ใช้\s*คือ\s*",
)) + ")"
# Fixed values.
_ID_LINK = r"(?:[ \t]*[：:=][ \t]*|[ \t]+is[ \t]+|[ \t]*(?:为|是)[ \t]*|[ \t]+)"
_ID_VALUE = "[A-Z0-9][A-Z0-9_.-]{3,63}"


def _labelled(key, type_, confidence, before, value, gate, after="", ignore_case=True, **kw):
    return Rule(key, type_, confidence, value, before, after, ignore_case, gate=gate, **kw)


def _record(key, type_, labels, gate, confidence=0.95):
    return _labelled(key, type_, confidence, f"(?:{labels}){_ID_LINK}", _ID_VALUE, gate)


_OUT = not_after("A-Za-z0-9_")
_IN = not_before("A-Za-z0-9_")
CONTEXT = (
    _labelled(
        "B40", "PASSWORD", 0.98, _OUT + words(*_PW_KEYS, *_PW_BARE) + _IN + _PW_DELIM + "[\"']",
        r"[^\r\n\"']{6,256}",
        ("password", "passwd", "密码", "口令", "passwort", "mot", "contraseña", "パスワード", "비밀번호", "كلمة", "รหัสผ่าน"),
        "[\"']", check="password_ok", validated=True, post=("trim", "password_tail"),
    ),
    _labelled(
        "B41", "PASSWORD", 0.97, _OUT + words(*_PW_KEYS) + _IN + _PW_DELIM, r"[^\s\"'`]{6,256}",
        ("password", "密码", "passwort", "mot", "contraseña", "パスワード", "비밀번호", "كلمة", "รหัสผ่าน"),
        check="password_ok", validated=True, post=("password_tail",),
    ),
    _labelled(
        "B42", "SECRET", 0.96,
        "(?<![A-Za-z0-9_.])" + words(*_SECRET_KEYS)
        + r"(?![A-Za-z0-9_.])[\"'“”「」]?[ \t]*[:=：＝][ \t]*[\"'“”「」]?" + _SECRET_LOOK,
        _SECRET_VALUE, _SECRET_GATE,
    ),
    _labelled("B43", "SECRET", 0.96, _STATEMENTS + _SECRET_LOOK, _SECRET_VALUE, _STATEMENT_GATE),
    _labelled(
        "B44", "SECRET", 0.98, r"discord[a-z0-9_ .,\-\"']{0,25}(?:=|>|:=|\|\||:|=>).{0,5}[\"']?", "[a-f0-9]{64}",
        ("discord",), not_before("a-f0-9"), validated=True,
    ),
    _labelled(
        "B45", "CARD_SECURITY_CODE", 0.99,
        r"(?:CVV2?|CVC2?|card\s+security\s+code|安全代码|安全码)\s*(?:[=:：]|为|是)?\s*", r"\d{3,4}",
        ("cvv", "cvc", "card", "安全代码", "安全码"), r"(?!\d)", validated=True,
    ),
    _labelled(
        "B46", "CARD_EXPIRY", 0.97,
        r"(?:有效期|expiration\s+date|expiry(?:\s+date)?)\s*(?:[=:：]|为|是|is)?\s*", r"\d{1,2}\s*[/.-]\s*\d{2,4}",
        ("有效期", "expiration", "expiry"), check="card_expiry", validated=True,
    ),
    _labelled(
        "B47", "PHONE", 0.96, f"(?:{_PHONE_KEYS}){_COPULA}", r"\+?\d(?:[\d ()-]{5,25}\d)", _PHONE_GATE,
        check="intl_phone", validated=True,
    ),
    _labelled(
        "B48", "CN_LANDLINE", 0.93, r"(?:座机|固定电话|联系电话|传真)\s*[：:=]?\s*",
        r"(?:\(?0\d{2,3}\)?[- ]?)?\d{7,8}(?:-\d{1,6})?", ("座机", "固定电话", "联系电话", "传真"), ignore_case=False,
    ),
    _labelled(
        "B49", "IP_ADDRESS", 0.94, r"(?:IPv4|Internal\s+IP|IP(?:地址)?|服务器地址|主机地址)\s*[：:=]?\s*",
        r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)", ("ip", "服务器地址", "主机地址"), check="ipv4", validated=True,
        gate_regex=r"(?U)\d\.\d{1,3}\.\d",
    ),
    _labelled(
        "B50", "IPV6_ADDRESS", 0.97, r"IPv6(?:\s+address)?\s*(?:[：:=]|为|是|is|est|ist|es|lautet)?\s*",
        "[0-9A-Fa-f:]{2,45}", ("ipv6",), check="ipv6", validated=True,
    ),
    _labelled(
        "B51", "MAC_ADDRESS", 0.98, r"(?:MAC(?:\s+address)?|物理地址)\s*[：:=]?\s*",
        r"[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\3){4}[0-9A-Fa-f]{2}", ("mac", "物理地址"), check="mac", validated=True,
        gate_regex="(?i)[0-9a-f]{2}[:-][0-9a-f]{2}[:-]",
    ),
    _labelled(
        "B52", "PRIVATE_URL", 0.9, r"(?:个人主页|私有网址|回调地址|内网地址|服务地址)\s*[：:=]?\s*",
        r"https?://[^\s，。；;]+", ("个人主页", "私有网址", "回调地址", "内网地址", "服务地址"),
    ),
    _labelled(
        "B53", "PRIVATE_URL", 0.9,
        r"(?<![A-Za-z0-9_-])(?:Database\s+Host|Host|数据库主机)(?![A-Za-z0-9_-])\s*[：:=]\s*",
        r"[A-Z0-9.-]+\.[A-Z]{2,63}", ("host", "数据库主机"),
    ),
    _labelled(
        "B54", "CN_ID_CARD", 0.88, r"身份证(?:测试)?(?:号码|号)?\s*(?:[：:=]|为|是)?\s*", r"(?:\d{17}[0-9Xx]|\d{15})",
        ("身份证",), not_before("0-9A-Za-z"), False, check="cn_id_card", validated=True,
    ),
    _labelled(
        "B55", "GOVERNMENT_ID", 0.96,
        r"(?:SSN|social\s+security\s+number|マイナンバー|주민등록번호)\s*(?:[：:=]|为|是|is|は|는|은)?\s*",
        r"\d[\d -]{7,18}\d", ("ssn", "social", "マイナンバー", "주민등록번호"),
    ),
    _labelled(
        "B56", "PASSPORT", 0.95, f"(?:{_PASSPORT_KEYS})" + _COPULA.replace("[=:：]", "[：:=]"),
        "[A-Z0-9](?:[A-Z0-9 -]{4,18}[A-Z0-9])",
        ("passport", "passnummer", "passeport", "pasaporte", "паспорта", "جواز", "หมายเลขหนังสือเดินทาง", "パスポート番号", "여권번호"),
    ),
    _labelled(
        "B57", "BIC", 0.98, r"(?:BIC|SWIFT(?:\s+code)?)\s*[：:=]?\s*", "[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?",
        ("bic", "swift"), validated=True,
    ),
    _labelled(
        "B58", "CN_BIRTH_DATE", 0.95, r"(?:出生日期|出生年月|生日)\s*(?:[：:=]|为|是)?\s*",
        r"(?:19|20)\d{2}(?:"
        rf"年{_MONTH}月{_DAY}[日号]?(?!\d)|年{_MONTH}月(?!\d|[日号])"
        rf"|-{_MONTH}-{_DAY}(?!\d)|/{_MONTH}/{_DAY}(?!\d)|\.{_MONTH}\.{_DAY}(?!\d)"
        rf"|[-/.]{_MONTH}(?![-/.\d]))",
        ("出生日期", "出生年月", "生日"), ignore_case=False, validated=True,
    ),
    _labelled(
        "B59", "CN_SOCIAL_ACCOUNT", 0.92, r"(?:微信号|微信|WeChat|QQ(?:号)?|钉钉号)\s*[：:=]?\s*",
        r"(?:[A-Za-z][-_A-Za-z0-9]{5,19}|[1-9]\d{4,11})", ("微信", "wechat", "qq", "钉钉号"),
    ),
    _labelled(
        "B60", "CN_ACCOUNT", 0.89,
        r"(?:账号|账户|工号|学号|社保号|医保号|订单号|快递单号|客户编号|会员号|设备序列号|VIN)"
        r"(?:[ \t]*[：:=][ \t]*|[ \t]*(?:为|是)[ \t]*)",
        "[A-Z0-9][A-Z0-9_.-]{4,63}",
        ("账号", "账户", "工号", "学号", "社保号", "医保号", "订单号", "快递单号", "客户编号", "会员号", "设备序列号", "vin"),
    ),
    _labelled(
        "B61", "USERNAME", 0.91, _OUT + words(*_USER_KEYS) + r"[ \t]*[=:：][ \t]*['\"]?", _USER_VALUE,
        ("user", "用户名", "公司账号", "登录id", "ログインid", "계정", "identifiant", "benutzername", "usuario", "логин", "اسم", "ชื่อผู้ใช้"),
        post=("prose_username",),
    ),
    _labelled(
        "B62", "USERNAME", 0.91, _USER_STATEMENTS + r"['\"]?", _USER_VALUE,
        ("user", "用户名", "公司账号", "登录账号", "登录id", "benutzername", "usuario", "identifiant", "ログインid", "계정", "اسم", "ชื่อผู้ใช้"),
        post=("prose_username",),
    ),
    _record("B63", "MEDICAL_RECORD_ID", r"medical\s+record(?:\s+test)?\s+(?:ID|number)|MRN|病历号|住院号|门诊号",
            ("medical", "mrn", "病历号", "住院号", "门诊号")),
    _record("B64", "INSURANCE_ID", r"insurance\s+policy(?:\s+test)?\s+(?:ID|number)|医保号|社保卡号|保险号",
            ("insurance", "医保号", "社保卡号", "保险号")),
    _record("B65", "EMPLOYEE_ID", r"employee\s+(?:number|ID)|员工编号|员工工号|工号",
            ("employee", "员工编号", "工号")),
    _record("B66", "STUDENT_ID", r"student\s+(?:number|ID)|学号|学生证号", ("student", "学号", "学生证号")),
    _record(
        "B67", "RECORD_ID",
        r"employee\s+(?:number|ID)|student\s+ID|medical\s+record(?:\s+test)?\s+ID"
        r"|insurance\s+policy(?:\s+test)?\s+ID|Account\s+ID|员工编号",
        ("employee", "student", "medical", "insurance", "account", "员工编号"), 0.93,
    ),
)
EXACT_AND_CONTEXT = EXACT + tuple(
    replace(r, post=("doc_example", *r.post)) if r.type == "SECRET" else r for r in CONTEXT
)
EXACT_AND_CONTEXT = tuple(
    replace(r, post=("doc_example", *r.post)) if r.type == "SECRET" and "doc_example" not in r.post else r
    for r in EXACT_AND_CONTEXT
)

# --- Chinese names ----------------------------------------------------------
# Family names of the extraction whitelist, by frequency.
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑谢罗梁宋唐许韩冯邓曹"
    "彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金"
    "石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵"
    "万钱严覃武戴莫孔向汤"
)
COMPOUND = ("欧阳", "司马", "诸葛", "东方", "上官", "皇甫", "令狐")
# Two-character words that start like a name but are none.
NOT_NAMES = (
    "中国", "中华", "北京", "上海", "广州", "深圳", "天津", "重庆", "开发", "测试", "发布", "项目",
    "系统", "服务", "产品", "功能", "用户", "客户", "管理员", "张贴", "高大", "马路", "白云", "青山",
    "黄河", "长江", "东方", "黄金", "方针", "严厉", "金钱", "周报", "徐徐", "武力", "王道", "李子",
    "杨树", "林木", "蔡司", "夏天",
)
# Single-character family names of labelled names, in the order of the classical list of family names.
LABELLED_SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳鲍史唐费"
    "廉岑薛雷贺倪汤滕殷罗毕郝邬安常乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹姚邵湛汪祁毛禹狄米贝明臧计伏成戴谈宋茅庞熊纪舒屈项祝董梁杜"
    "阮蓝闵席季麻强贾路娄危江童颜郭梅盛林刁钟徐邱骆高夏蔡田樊胡凌霍虞万支柯昝管卢莫经房裘缪干解应宗宣丁邓郁单杭洪包诸左石崔吉龚程嵇邢"
    "裴陆荣翁荀羊於惠甄曲封芮储靳汲邴糜松井段富巫乌焦巴弓牧隗山谷车侯宓蓬全郗班仰秋仲伊宫宁仇栾暴甘钭厉戎祖武符刘景詹束龙叶幸司韶黎乔"
    "苍双闻莘党翟谭贡劳逄姬申扶堵冉宰郦雍郤璩桑桂濮牛寿通边扈燕冀郏浦尚农温别庄晏柴瞿阎充慕连茹习宦艾鱼容向古易慎戈廖庾终暨居衡步都耿"
    "满弘匡国文寇广禄阙东欧殳沃利蔚越夔隆师巩厍聂晁勾敖融冷訾辛阚那简饶空曾毋沙乜养鞠须丰巢关蒯相查后荆红游竺权逯盖益桓公"
)
# Further compound family names of labelled names.
MORE_COMPOUND = (
    "太史", "端木", "独孤", "南宫", "万俟", "闻人", "夏侯", "尉迟", "公羊", "赫连", "澹台", "宗政",
    "濮阳", "公冶", "太叔", "申屠", "公孙", "慕容", "仲孙", "钟离", "长孙", "宇文", "司徒", "鲜于",
    "司空", "闾丘", "子车", "亓官", "司寇", "巫马", "公西", "颛孙", "壤驷", "公良", "漆雕", "乐正",
    "宰父", "谷梁", "拓跋", "夹谷", "轩辕", "段干", "百里", "呼延", "东郭", "南门", "羊舌", "微生",
)

CJK = r"[一-鿿]"
_BUILTIN = ("multilingual_rules",)


def cn_name_value(surnames: str = LABELLED_SURNAMES, compound=COMPOUND + MORE_COMPOUND) -> str:
    return (
        rf"(?:(?:{'|'.join(compound)}){CJK}{{1,2}}|[{surnames}]{CJK}{{1,2}}"
        r"|[一-鿿]{2,4}·[A-Za-z一-鿿·]{1,12})"
    )


def cn_name_rules(surnames: str = LABELLED_SURNAMES, compound=COMPOUND + MORE_COMPOUND):
    """Chinese names by label, predicate, self-introduction and title."""
    name = cn_name_value(surnames, compound)
    # Role labels and titles.
    labels = ("姓名", "联系人", "收件人", "患者", "客户", "员工", "申请人", "负责人", "法定代表人", "法人", "户主", "开户名", "经办人")
    roles = ("负责人", "联系人", "法定代表人", "法人", "户主", "开户名", "经办人", "姓名")
    titles = ("先生", "女士", "医生", "老师", "经理", "主任")
    mk = lambda key, before, gate, after="": Rule(
        key, "CN_NAME", 0.84, name, before, after, gate=gate, sources=_BUILTIN
    )
    return (
        mk("B68a", rf"(?:{'|'.join(labels)})\s*[：:=]\s*", labels),
        mk("B68b", rf"(?:{'|'.join(roles)})\s*(?:为|是)\s*", roles),
        mk("B68c", r"(?:我叫|我是|本人)\s*", ("我叫", "我是", "本人")),
        mk("B68d", r"(?<![一-鿿])", titles, rf"(?:{'|'.join(titles)})(?![一-鿿])"),
    )


_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# Fixed values.
_LATIN_WORD = rf"(?:[A-ZÀ-ÖØ-Þ]\.|[A-ZÀ-ÖØ-Þ](?:[{_LATIN}'’-]*[{_LATIN}])?)"
_LATIN_NAME = rf"{_LATIN_WORD}(?:[ \t]+{_LATIN_WORD}){{1,4}}"
# Fixed values.
_CYR_WORD = r"(?:[А-ЯЁ]\.|[А-ЯЁ](?:[А-Яа-яЁё'’-]*[А-Яа-яЁё])?)"
_CYR_NAME = rf"{_CYR_WORD}(?:[ \t]+{_CYR_WORD}){{1,4}}"


def person_rules(surnames: str = LABELLED_SURNAMES, compound=COMPOUND + MORE_COMPOUND):
    """Self-introductions and labelled names in nine languages."""
    mk = lambda key, before, value, gate, after="", ic=True: Rule(
        key, "PRIVATE_PERSON", 0.90, value, before, after, ic, gate=gate, sources=_BUILTIN
    )
    # The introducing phrases.
    return (
        mk("B69a", r"(?:My\s+name\s+is|Customer\s+Name\s*:|Name\s*:)\s*", _LATIN_NAME, ("name",)),
        mk("B69b", r"Je\s+m['’]appelle\s+", _LATIN_NAME, ("appelle",)),
        mk("B69c", r"Mein\s+Name\s+ist\s+", _LATIN_NAME, ("mein",)),
        mk("B69d", r"Me\s+llamo\s+", _LATIN_NAME, ("llamo",)),
        mk("B69e", r"Меня\s+зовут\s+", _CYR_NAME, ("меня",)),
        mk(
            "B69f", r"(?:私の名前は|(?:お客様の)?(?:姓名|氏名|お名前)\s*[：:]|Customer\s+Name\s*:)\s*",
            r"[぀-ヿ㐀-鿿]{2,12}", ("私の名前は", "姓名", "氏名", "お名前", "customer"),
            r"(?=[、，。\n\s]|です|$)",
        ),
        mk("B69g", r"(?:제\s+이름은|负责人\s*)\s*", "[가-힣]{2,8}", ("이름은", "负责人"), r"(?=입니다|\s+can|\s|[.\n]|$)"),
        mk("B69h", r"اسمي\s+", r"[؀-ۿ]+(?:\s+[؀-ۿ]+){0,4}", ("اسمي",), r"(?=[.\n،,;؛]|$)", False),
        mk("B69i", r"ฉันชื่อ\s+", r"[฀-๿]+(?:\s+[฀-๿]+){1,3}", ("ฉันชื่อ",), r"(?=\s+ที่อยู่|[.\n]|$)", False),
        mk("B69j", r"Please\s+contact\s+", cn_name_value(surnames, compound), ("please",), r"(?=\s+at)"),
    )


# Fixed values.
CN_ADDRESS_RULE = Rule(
    "B70", "CN_ADDRESS", 0.86,
    r"[^\n，,。；;]{5,100}(?:省|自治区|市|自治州|盟|区|县|旗|镇|乡|街道|路|街|巷|弄|村|社区|号|栋|室)[^\n，,。；;]{0,40}",
    r"(?:收货地址|家庭地址|通讯地址|开户地址|住址|地址|(?:目前)?住在)\s*[：:=为]?\s*",
    gate=("地址", "住址", "住在"), post=("cn_address_tail",), sources=_BUILTIN,
)


def address_rules():
    """Addresses introduced by a phrase in nine languages."""
    mk = lambda key, before, gate, value=r"[^\n.]{5,160}", after="", ic=True: Rule(
        key, "PRIVATE_ADDRESS", 0.88, value, before, after, ic, gate=gate, post=("address_tail",), sources=_BUILTIN
    )
    lazy = ".{5,160}?"
    # The introducing phrases.
    return (
        mk("B71a", r"(?:I\s+live\s+at|I\s+live\s+in)\s+", ("live",)),
        mk("B71b", r"J['’]habite\s+au\s+", ("habite",)),
        mk("B71c", r"Ich\s+wohne\s+in\s+der\s+", ("wohne",)),
        mk("B71d", r"Vivo\s+en\s+", ("vivo",)),
        mk("B71e", r"Я\s+живу\s+по\s+адресу\s*:\s*", ("живу",)),
        mk("B71f", r"أسكن\s+في\s+", ("أسكن",), ic=False),
        mk("B71g", r"(?:住所は|住所\s*[：:])\s*", ("住所",), lazy, r"(?=です|[。\n]|$)", False),
        mk("B71h", r"주소는\s*", ("주소는",), lazy, r"(?=입니다|[.\n]|$)", False),
        mk("B71i", r"ที่อยู่คือ\s*", ("ที่อยู่คือ",), lazy, r"(?=\s+หมายเลขโทรศัพท์|[.\n]|$)", False),
    )


def date_rules():
    """Birth dates in three multilingual shapes."""
    mk = lambda key, before, value, gate, ic=True: Rule(
        key, "PRIVATE_DATE", 0.91, value, before, "", ic, gate=gate, sources=_BUILTIN
    )
    # The introducing phrases.
    return (
        mk(
            "B72a", r"(?:出生日期|出生年月|生日|生年月日|생년월일)\s*(?:[：:=]|为|是|は|는|은)?\s*",
            rf"(?:19|20)\d{{2}}\s*(?:年|년|[-/.])\s*{_MONTH}\s*(?:月|월|[-/.])\s*{_DAY}\s*(?:日|일)?(?!\d)",
            ("出生日期", "出生年月", "生日", "生年月日", "생년월일"), False,
        ),
        mk(
            "B72b", r"(?:My\s+date\s+of\s+birth\s+is|date\s+of\s+birth\s+is)\s*",
            r"[^\W\d_]{3,20}\s+\d{1,2},\s*(?:19|20)\d{2}", ("birth",),
        ),
        mk(
            "B72c",
            r"(?:Ma\s+date\s+de\s+naissance\s+est\s+le|Mein\s+Geburtsdatum\s+ist\s+der|Nací\s+el|Дата\s+рождения\s*:"
            r"|تاريخ\s+الميلاد\s+هو|วันเกิดคือ)\s*",
            r"\d{1,2}\s+[^\W\d_]{3,24}\s+(?:19|20)\d{2}(?:\s+года)?",
            ("naissance", "geburtsdatum", "nací", "рождения", "تاريخ", "วันเกิดคือ"),
        ),
    )


# Every match of these rules holds a digit.
_WITH_DIGIT = (
    "B27", "B29", "B30", "B31", "B33", "B34", "B35", "B36", "B37", "B39", "B45", "B46", "B47", "B48", "B49", "B54", "B55",
    "B58", "B72a", "B72b", "B72c",
)

# Characters of which every match of these rules holds one.
_WITH_SIGN = {
    "B3": "-", "B5": "_", "B6": "_", "B7": "-", "B8": "-", "B9": "-", "B10": "_", "B11": "-", "B13": "_", "B15": ":", "B16": ":", "B18": "_",
    "B22": "_", "B23": "-_", "B24": ":=", "B26": "-", "B32": ":", "B38": ":-", "B42": ":=：＝", "B51": ":-", "B53": ":=：", "B61": ":=：",
}
# Every match of these rules holds a capital letter followed by another or by a digit, whatever its other letters are.
_WITH_CAPS = ("B3", "B4", "B7", "B8", "B9", "B19", "B20", "B21")


def built_in_rules(surnames: str = LABELLED_SURNAMES, compound=COMPOUND + MORE_COMPOUND) -> tuple[Rule, ...]:
    """The whole deterministic list in arbitration order."""
    rules = (
        EXACT_AND_CONTEXT
        + cn_name_rules(surnames, compound)
        + person_rules(surnames, compound)
        + (CN_ADDRESS_RULE,)
        + address_rules()
        + date_rules()
    )
    return tuple(
        replace(r, order=i, digit=r.key in _WITH_DIGIT, foreign=r.key == "B37", signs=_WITH_SIGN.get(r.key, ""), caps=r.key in _WITH_CAPS)
        for i, r in enumerate(rules)
    )


# --- Chinese extraction (second built-in detector) ---------------------------
# Administrative vocabulary of Chinese addresses.
_PROVINCE = (
    "河北|山西|辽宁|吉林|黑龙江|江苏|浙江|安徽|福建|江西|山东|河南|湖北|湖南|广东|海南|四川|贵州|云南|陕西|甘肃|青海"
    "|台湾|内蒙古|广西|西藏|宁夏|新疆|北京|天津|上海|重庆|香港|澳门"
)
_ADMIN = "省|自治区|特别行政区|市|地区|盟|自治州|区|县|县级市|旗|海域"
# Fixed values.
_STEP = "市|区|县|镇|街道|路|街|道|弄|巷|胡同"
_DETAIL = (
    "(?:[0-9一二三四五六七八九十百]+号|[0-9一二三四五六七八九十百A-Za-z_-]+(?:室|号楼|幢|栋|单元|层|楼)"
    r"|[一-龥0-9A-Za-z_-]{2,20}(?:大厦|广场|中心|小区|园区|花园|公寓|家园|庄园|弄))"
)
# Fixed values.
_TITLE = "(?:先生|女士|老师|同学|医生|教授|经理|主任)"
_HAN = r"[一-龥]"
_LEFT = r"(?<![一-龥])"
_STOP = r"(?=[^一-龥]|$)"
_IE = ("chinese_ie",)


def extraction_name_rules(first_order: int = 1000) -> tuple[Rule, ...]:
    """Six name patterns, strongest first; whitelisting happens on the value."""
    mk = lambda key, conf, before, value, after, gate: Rule(
        key, "CN_NAME", conf, value, before, after, gate=gate, sources=_IE
    )
    # Fields, roles and acts that introduce a name.
    fields = "姓名|联系人|收件人|发件人|负责人|经办人|候选人|当事人|作者|客户"
    roles = "负责人|联系人|作者|经办人|当事人|候选人"
    acts = "请?通知|请?联系|找|转交给|拜访|采访|陪同"
    titles = tuple(_TITLE[3:-1].split("|"))
    rules = (
        mk("B81a", 0.92, rf"{_LEFT}(?:{fields})\s*[：:=]\s*", f"{_HAN}{{2,4}}?", f"{_TITLE}?{_STOP}", tuple(fields.split("|"))),
        mk("B81b", 0.92, rf"{_LEFT}(?:{roles})\s*(?:是|为)\s*", f"{_HAN}{{2,4}}?", f"{_TITLE}?{_STOP}", tuple(roles.split("|"))),
        mk("B81c", 0.92, rf"{_LEFT}(?:我叫|我是)\s*", f"{_HAN}{{2,4}}", _STOP, ("我叫", "我是")),
        mk("B81d", 0.90, _LEFT, f"{_HAN}{{2,3}}", rf"{_TITLE}(?![一-龥])", titles),
        mk("B81e", 0.88, rf"{_LEFT}由\s*", f"{_HAN}{{2,3}}", rf"{_TITLE}?\s*(?:负责|经办|承办)", ("由",)),
        mk(
            "B81f", 0.85, rf"{_LEFT}(?:{acts})\s*", f"{_HAN}{{2,3}}", rf"{_TITLE}?(?=[，。；;！？\s、\n]|$)",
            ("通知", "联系", "找", "转交给", "拜访", "采访", "陪同"),
        ),
    )
    return tuple(replace(r, order=first_order + i, foreign=True) for i, r in enumerate(rules))


EXTRACTION_ADDRESS_RULE = Rule(
    "B82", "CN_ADDRESS", 0.90,
    rf"(?:{_PROVINCE})(?:{_ADMIN})?(?:[^\s，。；;！？\n]{{1,25}}(?:{_STEP}))+(?:[^\s，。；;！？\n]{{0,40}}{_DETAIL})*",
    r"(?:(?:住在|寄往|寄到|送往|送至|发往|地址(?:是|为|：|:)?)\s*)?",
    ignore_case=True, gate=tuple(_PROVINCE.split("|")), sources=_IE, order=1006, foreign=True,
)
