"""XMP packets: RDF/XML to properties and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET

# Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "http://www.w3.org/XML/1998/namespace"
NAMESPACES = {
    "dc": "http://purl.org/dc/elements/1.1/", "xmp": "http://ns.adobe.com/xap/1.0/", "xmpRights": "http://ns.adobe.com/xap/1.0/rights/", "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
    "xmpBJ": "http://ns.adobe.com/xap/1.0/bj/", "xmpTPg": "http://ns.adobe.com/xap/1.0/t/pg/", "xmpDM": "http://ns.adobe.com/xmp/1.0/DynamicMedia/", "xmpNote": "http://ns.adobe.com/xmp/note/",
    "pdf": "http://ns.adobe.com/pdf/1.3/", "photoshop": "http://ns.adobe.com/photoshop/1.0/", "crs": "http://ns.adobe.com/camera-raw-settings/1.0/", "aux": "http://ns.adobe.com/exif/1.0/aux/",
    "tiff": "http://ns.adobe.com/tiff/1.0/", "exif": "http://ns.adobe.com/exif/1.0/", "exifEX": "http://cipa.jp/exif/1.0/", "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/",
    "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/", "plus": "http://ns.useplus.org/ldf/xmp/1.0/", "GPano": "http://ns.google.com/photos/1.0/panorama/",
    "mwg-rs": "http://www.metadataworkinggroup.com/schemas/regions/", "MP": "http://ns.microsoft.com/photo/1.2/", "stJob": "http://ns.adobe.com/xap/1.0/sType/Job#", "stEvt": "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#",
    "stRef": "http://ns.adobe.com/xap/1.0/sType/ResourceRef#", "stDim": "http://ns.adobe.com/xap/1.0/sType/Dimensions#", "stVer": "http://ns.adobe.com/xap/1.0/sType/Version#",
}
PREFIXES = {u: p for p, u in NAMESPACES.items()}
# Forms that properties are declared to have, of the XMP, IPTC and PLUS standards.  LangAlt is an Alt by language.
_FORMS = """
dc: contributor Bag coverage Simple creator Seq date Seq description LangAlt format Simple identifier Simple language Bag
    publisher Bag relation Bag rights LangAlt source Simple subject Bag title LangAlt type Bag
xmp: Advisory Bag BaseURL Simple CreateDate Simple CreatorTool Simple Identifier Bag Label Simple MetadataDate Simple
    ModifyDate Simple Nickname Simple Rating Simple Thumbnails Alt
xmpRights: Certificate Simple Marked Simple Owner Bag UsageTerms LangAlt WebStatement Simple
xmpMM: DerivedFrom Struct DocumentID Simple History Seq Ingredients Bag InstanceID Simple ManagedFrom Struct Manager Simple
    ManageTo Simple ManageUI Simple OriginalDocumentID Simple Pantry Bag RenditionClass Simple RenditionParams Simple
    VersionID Simple Versions Seq
xmpBJ: JobRef Bag
xmpTPg: Colorants Seq Fonts Bag MaxPageSize Struct NPages Simple PlateNames Seq
xmpDM: artist Simple album Simple genre Simple logComment Simple projectRef Struct Tracks Bag videoFrameSize Struct
photoshop: AuthorsPosition Simple CaptionWriter Simple Category Simple City Simple Country Simple Credit Simple
    DateCreated Simple DocumentAncestors Bag Headline Simple History Simple Instructions Simple Source Simple State Simple
    SupplementalCategories Bag TextLayers Seq TransmissionReference Simple Urgency Simple
Iptc4xmpCore: CountryCode Simple CreatorContactInfo Struct IntellectualGenre Simple Location Simple Scene Bag SubjectCode Bag
Iptc4xmpExt: AddlModelInfo Simple ArtworkOrObject Bag CVterm Bag Event LangAlt LocationCreated Bag LocationShown Bag
    ModelAge Bag OrganisationInImageCode Bag OrganisationInImageName Bag PersonInImage Bag RegistryId Bag
plus: ImageSupplier Seq ImageSupplierImageID Simple Licensee Seq LicensorNotes LangAlt ModelReleaseID Bag
    ModelReleaseStatus Simple PropertyReleaseID Bag PropertyReleaseStatus Simple
tiff: Artist Simple BitsPerSample Seq Copyright LangAlt ImageDescription LangAlt Make Simple Model Simple Software Simple
    TransferFunction Seq WhitePoint Seq YCbCrCoefficients Seq
exif: CFAPattern Struct ComponentsConfiguration Seq Flash Struct ISOSpeedRatings Seq OECF Struct
    SpatialFrequencyResponse Struct SubjectArea Seq UserComment LangAlt
"""


def _declared(text: str) -> dict[str, str]:
    out, group, words = {}, "", iter(text.split())
    for word in words:
        if word.endswith(":"):
            group, word = word, next(words)
        out[group + word] = next(words)
    return out


DECLARED = _declared(_FORMS)
#: The RDF form of each declared array.
FORMS = {name: "Alt" if form == "LangAlt" else form for name, form in DECLARED.items() if form not in ("Simple", "Struct")}


def register_namespace(prefix: str, uri: str) -> None:
    """One more prefix; of a prefix or namespace that is known the new pair counts."""
    PREFIXES.pop(NAMESPACES.get(prefix, ""), None)
    NAMESPACES[prefix] = uri
    PREFIXES[uri] = prefix
    ET.register_namespace(prefix, uri)


for _prefix, _uri in {**NAMESPACES, "rdf": RDF, "x": "adobe:ns:meta/"}.items():
    ET.register_namespace(_prefix, _uri)


def _name(tag: str) -> str:
    space, _, local = tag[1:].partition("}") if tag.startswith("{") else ("", "", tag)
    return f"{PREFIXES.get(space, space)}:{local}" if space else local


def _value(node: ET.Element):
    """Text, a list (with its form) or a structure; rdf:value stands for the rest of its node."""
    kids = list(node)
    if node.get(f"{{{RDF}}}resource") is not None:
        return node.get(f"{{{RDF}}}resource")
    if len(kids) == 1 and (form := kids[0].tag.removeprefix(f"{{{RDF}}}")) in ("Alt", "Bag", "Seq"):
        items = [{"lang": li.get(f"{{{XML}}}lang"), "value": _value(li)} if form == "Alt" and li.get(f"{{{XML}}}lang") else _value(li) for li in kids[0]]
        return {"form": form, "items": items}
    if len(kids) == 1 and kids[0].tag == f"{{{RDF}}}Description":
        node, kids = kids[0], list(kids[0])
    fields = {_name(k): v for k, v in node.attrib.items() if not k.startswith((f"{{{RDF}}}", f"{{{XML}}}"))}
    fields |= {_name(k.tag): _value(k) for k in kids}
    if "rdf:value" in fields or f"{RDF}:value" in fields:
        return fields.get("rdf:value", fields.get(f"{RDF}:value"))
    if fields or node.get(f"{{{RDF}}}parseType") == "Resource":
        return {"form": "Struct", "fields": fields}
    return node.text or ""


def read(packet: str) -> dict | None:
    """{prefix:name: value} of all descriptions, or None if it is no RDF; declarations of entities are refused."""
    if "<!DOCTYPE" in packet or "<!ENTITY" in packet:
        return None
    root = _root(packet)
    if root is None:
        return None
    out: dict = {}
    for block in _blocks(root):
        for k, v in block.attrib.items():
            if not k.startswith((f"{{{RDF}}}", f"{{{XML}}}")):
                out[_name(k)] = v
        for kid in block:
            out[_name(kid.tag)] = _value(kid)
    return out


def _root(packet: str) -> ET.Element | None:
    if "<!DOCTYPE" in packet or "<!ENTITY" in packet:
        return None
    try:
        return ET.fromstring(packet[packet.find("<") :].strip("\0 \r\n\t") if "<?xpacket" not in packet else _inner(packet))
    except ET.ParseError:
        return None


def _blocks(root: ET.Element) -> list[ET.Element]:
    """The descriptions right under rdf:RDF."""
    return [d for r in root.iter(f"{{{RDF}}}RDF") for d in r if d.tag == f"{{{RDF}}}Description"]


def _tag(name: str) -> str:
    prefix, _, local = name.partition(":")
    return f"{{{NAMESPACES.get(prefix, prefix)}}}{local}"


def qualifiers(packet: str, name: str) -> dict[str, str]:
    """What stands beside rdf:value in a property, and its xml:lang."""
    root = _root(packet)
    node = next((k for b in _blocks(root) for k in b if k.tag == _tag(name)), None) if root is not None else None
    if node is None:
        return {}
    inner = node[0] if len(node) == 1 and node[0].tag == f"{{{RDF}}}Description" else node
    fields = {k: v for k, v in inner.attrib.items() if not k.startswith(f"{{{RDF}}}")} | {k.tag: k.text or "" for k in inner}
    if not any(k.tag == f"{{{RDF}}}value" for k in inner) and f"{{{RDF}}}value" not in inner.attrib:
        fields = {}
    fields = {_name(k): v for k, v in fields.items() if k != f"{{{RDF}}}value" and not k.startswith(f"{{{XML}}}")}
    if lang := node.get(f"{{{XML}}}lang", inner.get(f"{{{XML}}}lang")):
        fields["xml:lang"] = lang
    return fields


def edit(packet: str | None, changes: dict, padding: int = 0) -> str:
    """The packet with properties set (values as write() takes them) or, by None, removed in all descriptions; the rest stays."""
    root = _root(packet) if packet else None
    if root is None:
        return write({k: v for k, v in changes.items() if v is not None}, padding)
    blocks = _blocks(root)
    for block in blocks:
        for name in changes:
            block.attrib.pop(_tag(name), None)
            for kid in [k for k in block if k.tag == _tag(name)]:
                block.remove(kid)
    added = {k: v for k, v in changes.items() if v is not None}
    if added:
        if not blocks:
            raise ValueError("the packet has no description")
        extra = _root(write(added))
        blocks[0].extend(list(_blocks(extra)[0]))
    core = ET.tostring(root, encoding="unicode")
    return f'<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>{core}{" " * padding}<?xpacket end="w"?>'


def text_of(value, language: str = "x-default") -> str | None:
    """A property as one text: of an Alt the language's, its main language's, the default's or the first item."""
    if value is None or isinstance(value, str):
        return value
    items = value.get("items") or []
    if value.get("form") == "Struct" or not items:
        return None
    told = {i["lang"].lower(): i["value"] for i in items if isinstance(i, dict) and "lang" in i}
    first = items[0]["value"] if isinstance(items[0], dict) and "lang" in items[0] else items[0]
    found = told.get(language.lower(), next((v for k, v in told.items() if k.split("-")[0] == language.lower().split("-")[0]), told.get("x-default", first)))
    return found if isinstance(found, str) else None


def list_of(value) -> list[str]:
    """An array's texts; a text alone is a list of it."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    return [i["value"] if isinstance(i, dict) and "lang" in i else i for i in value.get("items", []) if isinstance(i, str) or (isinstance(i, dict) and isinstance(i.get("value"), str))]


def plain(value):
    """A value as read() gives it in the form that write() takes."""
    if not isinstance(value, dict):
        return value
    if "lang" in value:
        return value["value"]
    if value.get("form") == "Struct":
        return {k: plain(v) for k, v in value["fields"].items()}
    items = value["items"]
    if value["form"] == "Alt" and items and all(isinstance(i, dict) and "lang" in i for i in items):
        return {i["lang"]: i["value"] for i in items}
    return [plain(i) for i in items]


#: Shortcut projections: name to property and whether it is a list.
SHORTCUTS = {"title": ("dc:title", False), "description": ("dc:description", False), "rights": ("dc:rights", False), "creators": ("dc:creator", True), "keywords": ("dc:subject", True)}


def shortcuts(properties: dict) -> dict:
    return {k: list_of(properties.get(p)) if many else text_of(properties.get(p)) for k, (p, many) in SHORTCUTS.items()}


def _inner(packet: str) -> str:
    begin = packet.find("?>", packet.find("<?xpacket")) + 2
    end = packet.rfind("<?xpacket")
    return packet[begin : end if end > begin else len(packet)].strip()


def write(properties: dict, padding: int = 0) -> str:
    """A packet of properties: str, list (in its declared form, else Bag), {lang: text} for Alt, {field: value} else."""
    used = sorted({k.split(":")[0] for k in _keys(properties)})
    head = "".join(f' xmlns:{p}="{NAMESPACES[p]}"' for p in used)
    body = "".join(_element(k, v) for k, v in properties.items())
    core = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description rdf:about=""{head}>{body}</rdf:Description></rdf:RDF></x:xmpmeta>'
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?>{core}{" " * padding}<?xpacket end="w"?>'


def _keys(value):
    if isinstance(value, dict):
        for k, v in value.items():
            if ":" in k:
                yield k
            yield from _keys(v)
    elif isinstance(value, list):
        for v in value:
            yield from _keys(v)


def _escaped(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _inside(name: str, value) -> tuple[str, str]:
    """Attributes and content of an element."""
    if isinstance(value, list):
        form = FORMS.get(name, "Bag")
        return "", f"<rdf:{form}>" + "".join("<rdf:li{}>{}</rdf:li>".format(*_inside("", v)) for v in value) + f"</rdf:{form}>"
    if isinstance(value, dict) and FORMS.get(name) == "Alt":
        langs = sorted(value, key=lambda k: k != "x-default")
        return "", "<rdf:Alt>" + "".join(f'<rdf:li xml:lang="{_escaped(k)}">{_escaped(value[k])}</rdf:li>' for k in langs) + "</rdf:Alt>"
    if isinstance(value, dict):
        return ' rdf:parseType="Resource"', "".join(_element(k, v) for k, v in value.items())
    return "", _escaped("True" if value is True else "False" if value is False else value)


def _element(name: str, value) -> str:
    attributes, content = _inside(name, value)
    return f"<{name}{attributes}>{content}</{name}>"


def at(properties: dict, path: str):
    """The value at prefix:name[2]/prefix:field; places count from 1, prefixes of later steps do not matter."""
    value = None
    for i, step in enumerate(path.split("/")):
        name, _, place = step.partition("[")
        if i == 0:
            value = properties.get(name)
        else:
            fields = value.get("fields", {}) if isinstance(value, dict) else {}
            value = next((v for k, v in fields.items() if k.split(":")[-1] == name.split(":")[-1]), None)
        if place and isinstance(value, dict):
            items, n = value.get("items", []), int(place.rstrip("]"))
            value = items[n - 1] if 0 < n <= len(items) else None
        if isinstance(value, dict) and "lang" in value:
            value = value["value"]
    return value


def departures(properties: dict) -> list[tuple[str, str, str]]:
    """(name, form it has, form it should have) of properties that their declaration does not allow."""
    out = []
    for name, value in properties.items():
        has = value["form"] if isinstance(value, dict) else "Simple"
        due = FORMS.get(name, DECLARED.get(name))
        if due is not None and has != due:
            out.append((name, has, due))
    return out
