"""Site constants as parameters. Nothing in the engine hard-codes a site."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: default word lists, selectors and templates -------------------
DEPARTMENT_KEYWORDS = (
    "Biblioteconomía", "Bioingeniería", "Ciencia e Ingeniería", "Ciencias Sociales",
    "Comunicación", "Derecho Internacional", "Derecho Penal", "Derecho Privado",
    "Derecho Público", "Derecho Social", "Economía", "Estadística", "Física",
    "Humanidades", "Informática", "Ingeniería Aeroespacial", "Ingeniería de Sistemas",
    "Ingeniería Eléctrica", "Ingeniería Mecánica", "Ingeniería Telemática",
    "Ingeniería Térmica", "Matemáticas", "Mecánica de Medios", "Neurociencia",
    "Tecnología Electrónica", "Teoría de la Señal",
)
STAFF_KEYWORDS = (
    "personal", "profesorado", "profesor", "profesores", "titular", "asociado",
    "plantilla", "staff", "miembros", "listado", "directorio", "equipo",
)
SPECIFIC_LINK_WORDS = ("satellite", "departamento", "personal", "listado")
WALK_KEYWORDS = (
    "personal", "profesor", "profesores", "plantilla", "staff", "miembros", "equipo",
    "directorio", "listado",
)
CONTACT_WORDS = ("profesor", "personal", "email", "@", "correo")
PROFILE_URL_PARTS = ("/faculty/", "/people/", "/profile", "/profiles/", "/user/", "/directory/")
PLACEHOLDER_NAMES = ("departamento", "dept", "depto")
LINE_LABELS = ("email", "correo", "tel", "phone", "fax")
MALFORMED_SUFFIXES = ("Ficha", "Basic", "alvarado", "anton")
CARD_NAME_SELECTORS = (
    ".view-content .views-row h3 a",
    ".view-content .views-row h3",
    ".view-content .views-row .field--name-title a",
    ".view-content .views-row .field--name-title",
)
CARD_LINK_SELECTOR = ".view-content .views-row a[href]"
TITLE_SELECTORS = ("h1", "h2", ".page-title", ".node--title", "header h1", ".title")
PERSON_NAME_SELECTOR = '[itemscope][itemtype*="Person" i] [itemprop="name"]'
DEPARTMENT_BLOCK_SELECTORS = (
    "dl", ".field", ".profile-meta", ".node__meta", ".sidebar", ".field--name-field-department",
)
DEPARTMENT_FALLBACK_SELECTOR = ".department, .field--name-field-department"
PROFILE_BLOCK_SELECTORS = (
    "div.person", "div.profile", "div.staff-member", "div.contact", "div[class*='person']",
    "div[class*='profile']", "div[class*='staff']", "div[class*='member']", "div[class*='faculty']",
)
# (key, template) pairs; the key is looked up in the short department name
STAFF_URL_PATTERNS = (
    ("informatica", "{base}/ss/Satellite/DeptInformatica/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("informatica", "{base}/ss/Satellite/DeptInformatica/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("informatica", "{base}/ss/Satellite/DeptInformatica/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
    ("matematicas", "{base}/ss/Satellite/DeptMatematicas/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("matematicas", "{base}/ss/Satellite/DeptMatematicas/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("matematicas", "{base}/ss/Satellite/DeptMatematicas/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
    ("cienciasingenieriademateriales", "{base}/ss/Satellite/DeptCienIngMatIngQuim/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("cienciasingenieriademateriales", "{base}/ss/Satellite/DeptCienIngMatIngQuim/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("cienciasingenieriademateriales", "{base}/ss/Satellite/DeptCienIngMatIngQuim/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
    ("cienciassociales", "{base}/departamento-ciencias-sociales/personal-tiempo-completo"),
    ("cienciassociales", "{base}/departamento-ciencias-sociales/personal-asociado"),
    ("economia", "{base}/ss/Satellite/DeptEconomia/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("economia", "{base}/ss/Satellite/DeptEconomia/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("economia", "{base}/ss/Satellite/DeptEconomia/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
    ("fisica", "{base}/ss/Satellite/DeptFisica/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("fisica", "{base}/ss/Satellite/DeptFisica/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("fisica", "{base}/ss/Satellite/DeptFisica/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
    ("derecho", "{base}/ss/Satellite/DeptDerecho/es/ListadoPersonalDept/1371321047774/Profesores_Titulares"),
    ("derecho", "{base}/ss/Satellite/DeptDerecho/es/ListadoPersonalDept/1371321047774/Profesores_Asociados"),
    ("derecho", "{base}/ss/Satellite/DeptDerecho/es/ListadoPersonalDept/1371321047774/Profesores_permanentes"),
)
SEED_URLS = (
    "https://www.uc3m.es/ss/Satellite/DeptMatematicas/es/ListadoPersonalDept/1371321047774/Profesores_Titulares",
    "https://www.uc3m.es/departamento-ciencias-sociales/personal-tiempo-completo",
    "https://www.uc3m.es/ss/Satellite/DeptCienIngMatIngQuim/es/ListadoPersonalDept/1371322829661/Profesores_permanentes",
)
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SiteProfile:
    """Everything that differs from one site to the next."""

    domain: str
    base_url: str
    email_domains: tuple[str, ...]
    university: str
    site_suffix: str
    department_marker: str = "/Detalle/Organismo_C"
    web_label: str = "Web del departamento"
    mailbox_name: str = "Departamento"
    directory_label: str = "Varios"
    department_keywords: tuple[str, ...] = DEPARTMENT_KEYWORDS
    staff_keywords: tuple[str, ...] = STAFF_KEYWORDS
    specific_link_words: tuple[str, ...] = SPECIFIC_LINK_WORDS
    walk_keywords: tuple[str, ...] = WALK_KEYWORDS
    contact_words: tuple[str, ...] = CONTACT_WORDS
    staff_url_patterns: tuple[tuple[str, str], ...] = STAFF_URL_PATTERNS
    strict: bool = True  # refuse look-alike domains such as notuc3m.es


UC3M = SiteProfile("uc3m.es", "https://www.uc3m.es", ("uc3m.es", "pa.uc3m.es"), "UC3M", "UC3M")
