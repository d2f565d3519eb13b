"""Names and meanings of the fields that queries look up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids and names of tags by group, of the TIFF 6.0, Exif 3.0 and DCF standards and of Windows.
_TIFF = """
256 ImageWidth 257 ImageLength 258 BitsPerSample 259 Compression 262 PhotometricInterpretation 269 DocumentName
270 ImageDescription 271 Make 272 Model 273 StripOffsets 274 Orientation 277 SamplesPerPixel 278 RowsPerStrip
279 StripByteCounts 282 XResolution 283 YResolution 284 PlanarConfiguration 285 PageName 296 ResolutionUnit
301 TransferFunction 305 Software 306 DateTime 315 Artist 316 HostComputer 318 WhitePoint 319 PrimaryChromaticities
513 JPEGInterchangeFormat 514 JPEGInterchangeFormatLength 529 YCbCrCoefficients 530 YCbCrSubSampling 531 YCbCrPositioning
532 ReferenceBlackWhite 700 XMP 33432 Copyright 33723 IPTC 34377 PhotoshopIRB 34665 ExifIFD 34853 GPSInfoIFD 40091 XPTitle
40092 XPComment 40093 XPAuthor 40094 XPKeywords 40095 XPSubject 50341 PrintImageMatching
"""
_EXIF = """
33434 ExposureTime 33437 FNumber 34850 ExposureProgram 34852 SpectralSensitivity 34855 PhotographicSensitivity 34856 OECF
34864 SensitivityType 34865 StandardOutputSensitivity 34866 RecommendedExposureIndex 34867 ISOSpeed 34868 ISOSpeedLatitudeyyy
34869 ISOSpeedLatitudezzz 36864 ExifVersion 36867 DateTimeOriginal 36868 DateTimeDigitized 36880 OffsetTime
36881 OffsetTimeOriginal 36882 OffsetTimeDigitized 37121 ComponentsConfiguration 37122 CompressedBitsPerPixel
37377 ShutterSpeedValue 37378 ApertureValue 37379 BrightnessValue 37380 ExposureBiasValue 37381 MaxApertureValue
37382 SubjectDistance 37383 MeteringMode 37384 LightSource 37385 Flash 37386 FocalLength 37396 SubjectArea 37500 MakerNote
37510 UserComment 37511 LearningOptOutIn 37520 SubSecTime 37521 SubSecTimeOriginal 37522 SubSecTimeDigitized 37888 Temperature
37889 Humidity 37890 Pressure 37891 WaterDepth 37892 Acceleration 37893 CameraElevationAngle 40960 FlashpixVersion
40961 ColorSpace 40962 PixelXDimension 40963 PixelYDimension 40964 RelatedSoundFile 40965 InteroperabilityIFD 41483 FlashEnergy
41484 SpatialFrequencyResponse 41486 FocalPlaneXResolution 41487 FocalPlaneYResolution 41488 FocalPlaneResolutionUnit
41492 SubjectLocation 41493 ExposureIndex 41495 SensingMethod 41728 FileSource 41729 SceneType 41730 CFAPattern
41985 CustomRendered 41986 ExposureMode 41987 WhiteBalance 41988 DigitalZoomRatio 41989 FocalLengthIn35mmFilm
41990 SceneCaptureType 41991 GainControl 41992 Contrast 41993 Saturation 41994 Sharpness 41995 DeviceSettingDescription
41996 SubjectDistanceRange 41997 DevelopmentType 41998 DevelopmentTypeDescription 41999 DistortionCorrection
42000 ChromaticAberrationCorrection 42001 ShadingCorrection 42002 NoiseReduction 42016 ImageUniqueID 42032 CameraOwnerName
42033 BodySerialNumber 42034 LensSpecification 42035 LensMake 42036 LensModel 42037 LensSerialNumber 42038 Title
42039 Photographer 42040 ImageEditor 42041 CameraFirmware 42042 RAWDevelopingSoftware 42043 ImageEditingSoftware
42044 MetadataEditingSoftware 42080 CompositeImage 42081 SourceImageNumberOfCompositeImage
42082 SourceExposureTimesOfCompositeImage 42240 Gamma
"""
_GPS = """
0 GPSVersionID 1 GPSLatitudeRef 2 GPSLatitude 3 GPSLongitudeRef 4 GPSLongitude 5 GPSAltitudeRef 6 GPSAltitude 7 GPSTimeStamp
8 GPSSatellites 9 GPSStatus 10 GPSMeasureMode 11 GPSDOP 12 GPSSpeedRef 13 GPSSpeed 14 GPSTrackRef 15 GPSTrack
16 GPSImgDirectionRef 17 GPSImgDirection 18 GPSMapDatum 19 GPSDestLatitudeRef 20 GPSDestLatitude 21 GPSDestLongitudeRef
22 GPSDestLongitude 23 GPSDestBearingRef 24 GPSDestBearing 25 GPSDestDistanceRef 26 GPSDestDistance 27 GPSProcessingMethod
28 GPSAreaInformation 29 GPSDateStamp 30 GPSDifferential 31 GPSHPositioningError
"""
_INTEROP = "1 InteroperabilityIndex 2 InteroperabilityVersion 4096 RelatedImageFileFormat 4097 RelatedImageWidth 4098 RelatedImageLength"


def _pairs(group: str, text: str) -> list[tuple[str, int, str]]:
    words = text.split()
    return [(group, int(i), n) for i, n in zip(words[::2], words[1::2], strict=True)]


EXIF_TAGS = [*_pairs("TIFF", _TIFF), *_pairs("EXIF", _EXIF), *_pairs("GPS", _GPS), *_pairs("Interoperability", _INTEROP)]
#: Other names of tags.
EXIF_ALIASES = [("EXIF", 34855, "ISOSpeedRatings")]
# Meanings of values, of the same standards.
EXIF_MEANINGS = [
    *((274, i + 1, m) for i, m in enumerate(["top, left", "top, right", "bottom, right", "bottom, left", "left, top", "right, top", "right, bottom", "left, bottom"])),
    (296, 1, "No absolute unit"), (296, 2, "Inches"), (296, 3, "Centimeters"), (531, 1, "Centered"), (531, 2, "Co-sited"), (284, 1, "Chunky"), (284, 2, "Planar"),
    (259, 1, "Uncompressed"), (259, 6, "JPEG"), (262, 2, "RGB"), (262, 6, "YCbCr"), (40961, 1, "sRGB"), (40961, 65535, "Uncalibrated"),
    *((34850, i, m) for i, m in enumerate(["Not defined", "Manual", "Normal program", "Aperture priority", "Shutter priority", "Creative program", "Action program", "Portrait mode", "Landscape mode"])),
    *((37383, i, m) for i, m in enumerate(["Unknown", "Average", "Center-weighted average", "Spot", "MultiSpot", "Pattern", "Partial"])), (37383, 255, "Other"),
    (37384, 0, "Unknown"), (37384, 1, "Daylight"), (37384, 2, "Fluorescent"), (37384, 3, "Tungsten"), (37384, 4, "Flash"), (37384, 9, "Fine weather"), (37384, 10, "Cloudy weather"), (37384, 11, "Shade"), (37384, 255, "Other"),
    (41985, 0, "Normal process"), (41985, 1, "Custom process"), (41986, 0, "Auto exposure"), (41986, 1, "Manual exposure"), (41986, 2, "Auto bracket"), (41987, 0, "Auto"), (41987, 1, "Manual"),
    *((41990, i, m) for i, m in enumerate(["Standard", "Landscape", "Portrait", "Night scene"])), *((41991, i, m) for i, m in enumerate(["None", "Low gain up", "High gain up", "Low gain down", "High gain down"])),
    *((tag, i, m) for tag in (41992, 41994) for i, m in enumerate(["Normal", "Soft", "Hard"])), *((41993, i, m) for i, m in enumerate(["Normal", "Low", "High"])), *((41996, i, m) for i, m in enumerate(["Unknown", "Macro", "Close view", "Distant view"])),
]
# IPTC datasets of the IIM standard by record, and which repeat.
_IPTC = {
    1: "0 EnvelopeRecordVersion 5 Destination 20 FileFormat 22 FileVersion 30 ServiceIdentifier 40 EnvelopeNumber 50 ProductID 60 EnvelopePriority 70 DateSent 80 TimeSent 90 CodedCharacterSet 100 UniqueObjectName 120 ARMIdentifier 122 ARMVersion",
    2: """0 ApplicationRecordVersion 3 ObjectTypeReference 4 ObjectAttributeReference 5 ObjectName 7 EditStatus 8 EditorialUpdate 10 Urgency
        12 SubjectReference 15 Category 20 SupplementalCategories 22 FixtureIdentifier 25 Keywords 26 ContentLocationCode 27 ContentLocationName
        30 ReleaseDate 35 ReleaseTime 37 ExpirationDate 38 ExpirationTime 40 SpecialInstructions 42 ActionAdvised 45 ReferenceService
        47 ReferenceDate 50 ReferenceNumber 55 DateCreated 60 TimeCreated 62 DigitalCreationDate 63 DigitalCreationTime 65 OriginatingProgram
        70 ProgramVersion 75 ObjectCycle 80 By-line 85 By-lineTitle 90 City 92 Sub-location 95 Province-State 100 Country-PrimaryLocationCode
        101 Country-PrimaryLocationName 103 OriginalTransmissionReference 105 Headline 110 Credit 115 Source 116 CopyrightNotice 118 Contact
        120 Caption-Abstract 121 LocalCaption 122 Writer-Editor 125 RasterizedCaption 130 ImageType 131 ImageOrientation 135 LanguageIdentifier
        150 AudioType 151 AudioSamplingRate 152 AudioSamplingResolution 153 AudioDuration 154 AudioOutcue 184 JobID 185 MasterDocumentID
        186 ShortDocumentID 187 UniqueDocumentID 188 OwnerID 200 ObjectPreviewFileFormat 201 ObjectPreviewFileVersion 202 ObjectPreviewData
        221 Prefs 225 ClassifyState 228 SimilarityIndex 230 DocumentNotes 231 DocumentHistory 232 ExifCameraInfo 255 CatalogSets""",
    3: """0 NewsPhotoVersion 10 IPTCPictureNumber 20 IPTCImageWidth 30 IPTCImageHeight 40 IPTCPixelWidth 50 IPTCPixelHeight 55 SupplementalType
        60 ColorRepresentation 64 InterchangeColorSpace 65 ColorSequence 66 ICC_Profile 70 ColorCalibrationMatrix 80 LookupTable 84 NumIndexEntries
        85 ColorPalette 86 IPTCBitsPerSample 90 SampleStructure 100 ScanningDirection 102 IPTCImageRotation 110 DataCompressionMethod
        120 QuantizationMethod 125 EndPoints 130 ExcursionTolerance 135 BitsPerComponent 140 MaximumDensityRange 145 GammaCompensatedValue""",
    7: "10 SizeMode 20 MaxSubfileSize 90 ObjectSizeAnnounced 95 MaximumObjectSize",
    8: "10 SubFile",
    9: "10 ConfirmedObjectSize",
}
IPTC_REPEATS = {(1, 5), (1, 50), (2, 4), (2, 12), (2, 20), (2, 25), (2, 26), (2, 27), (2, 45), (2, 47), (2, 50), (2, 80), (2, 85), (2, 118), (2, 122), (2, 255), (8, 10)}
IPTC_SETS = [(record, number, name, (record, number) in IPTC_REPEATS) for record, text in _IPTC.items() for _, number, name in _pairs("", text)]
#: Other names of datasets.
IPTC_ALIASES = {"Author": (2, 80), "AuthorTitle": (2, 85), "Copyright": (2, 116), "Description": (2, 120), "CreationDate": (2, 55), "CreationTime": (2, 60), "Software": (2, 65)}
# Ids and names of Photoshop image resources, path ids being a range.
RESOURCES = [
    (1000, 1000, "Channels"), (1001, 1001, "MacPrintInfo"), (1003, 1003, "IndexedColorTable"), (1005, 1005, "ResolutionInfo"), (1006, 1006, "AlphaChannelNames"), (1007, 1007, "DisplayInfo"), (1008, 1008, "CaptionString"),
    (1009, 1009, "BorderInformation"), (1010, 1010, "BackgroundColor"), (1011, 1011, "PrintFlags"), (1012, 1012, "GrayscaleHalftoning"), (1013, 1013, "ColorHalftoning"), (1014, 1014, "DuotoneHalftoning"),
    (1015, 1015, "GrayscaleTransfer"), (1016, 1016, "ColorTransfer"), (1017, 1017, "DuotoneTransfer"), (1018, 1018, "DuotoneImage"), (1019, 1019, "BlackAndWhite"), (1020, 1020, "Obsolete1"), (1021, 1021, "EPSOptions"),
    (1022, 1022, "QuickMask"), (1023, 1023, "Obsolete2"), (1024, 1024, "LayerState"), (1025, 1025, "WorkingPath"), (1026, 1026, "LayersGroup"), (1027, 1027, "Obsolete3"), (1028, 1028, "IPTC-NAA"), (1029, 1029, "RawImageMode"),
    (1030, 1030, "JPEGQuality"), (1032, 1032, "GridAndGuides"), (1033, 1033, "Thumbnail4"), (1034, 1034, "CopyrightFlag"), (1035, 1035, "URL"), (1036, 1036, "Thumbnail5"), (1037, 1037, "GlobalAngle"),
    (1038, 1038, "ColorSamplers"), (1039, 1039, "ICCProfile"), (1040, 1040, "Watermark"), (1041, 1041, "ICCUntagged"), (1042, 1042, "EffectsVisible"), (1043, 1043, "SpotHalftone"), (1044, 1044, "IDSeed"),
    (1045, 1045, "UnicodeAlphaNames"), (1046, 1046, "IndexedColorCount"), (1047, 1047, "TransparencyIndex"), (1049, 1049, "GlobalAltitude"), (1050, 1050, "Slices"), (1051, 1051, "WorkflowURL"), (1052, 1052, "JumpToXPEP"),
    (1053, 1053, "AlphaIdentifiers"), (1054, 1054, "URLList"), (1057, 1057, "VersionInfo"), (1058, 1058, "ExifData1"), (1060, 1060, "XMPData"), (2000, 2997, "PathInformation"), (2999, 2999, "ClippingPath"), (10000, 10000, "PrintFlagsInfo"),
]
# Privacy flags, and which tags, properties, datasets, resources, keywords and INFO fields each one removes.
PRIVACY = {"Location": 1, "Author": 2, "Description": 4, "CameraModel": 8, "SerialNumber": 16, "Timestamp": 32, "Software": 64, "MakerNote": 128, "Thumbnail": 256, "Interoperability": 512}
PRIVATE_EXIF = {
    "Location": "TIFF 34853",
    "Author": "TIFF 315 33432 40093 EXIF 42032 42039 42040",
    "Description": "TIFF 269 270 285 40091 40092 40094 40095 EXIF 37510 42038",
    "CameraModel": "TIFF 271 272 EXIF 42034 42035 42036",
    "SerialNumber": "EXIF 42016 42033 42037",
    "Timestamp": "TIFF 306 EXIF 36867 36868 36880 36881 36882 37520 37521 37522",
    "Software": "TIFF 305 316 EXIF 42041 42042 42043 42044",
    "MakerNote": "EXIF 37500",
    "Interoperability": "EXIF 40965",
}
PRIVATE_XMP = {
    "Location": """exif: GPSLatitude GPSLongitude GPSAltitude GPSAltitudeRef GPSTimeStamp GPSVersionID GPSMapDatum GPSImgDirection GPSImgDirectionRef
        GPSDestLatitude GPSDestLongitude GPSAreaInformation GPSProcessingMethod GPSSpeed GPSSpeedRef GPSTrack GPSTrackRef GPSDifferential
        GPSHPositioningError photoshop: City State Country Iptc4xmpCore: Location CountryCode Iptc4xmpExt: LocationCreated LocationShown""",
    "Author": """dc: creator rights publisher contributor xmpRights: Owner UsageTerms WebStatement Marked Certificate photoshop: Credit Source
        AuthorsPosition CaptionWriter Iptc4xmpCore: CreatorContactInfo Iptc4xmpExt: PersonInImage PersonInImageWDetails plus: ImageCreator
        ImageSupplier CopyrightOwner Licensor ImageSupplierImageID mwg-rs: Regions MP: RegionInfo""",
    "Description": """dc: title description subject photoshop: Headline Instructions Category SupplementalCategories TransmissionReference
        Iptc4xmpCore: SubjectCode IntellectualGenre Scene Iptc4xmpExt: Event AdditionalModelInformation xmp: Label Rating Nickname
        exif: UserComment tiff: ImageDescription""",
    "CameraModel": "tiff: Make Model exif: LensMake LensModel LensSpecification exifEX: LensMake LensModel LensSpecification aux: Lens LensInfo LensID",
    "SerialNumber": """exif: BodySerialNumber LensSerialNumber ImageUniqueID exifEX: BodySerialNumber LensSerialNumber aux: SerialNumber LensSerialNumber
        ImageNumber xmpMM: DocumentID InstanceID OriginalDocumentID DerivedFrom History Ingredients Pantry ManageTo ManageUI Manager ManagedFrom
        RenditionOf VersionID Versions Iptc4xmpExt: DigitalImageGUID RegistryId""",
    "Timestamp": """xmp: CreateDate ModifyDate MetadataDate exif: DateTimeOriginal DateTimeDigitized OffsetTime OffsetTimeOriginal
        OffsetTimeDigitized exifEX: OffsetTime OffsetTimeOriginal OffsetTimeDigitized tiff: DateTime photoshop: DateCreated""",
    "Software": "xmp: CreatorTool tiff: Software exif: CameraFirmware exifEX: CameraFirmware aux: Firmware pdf: Producer Creator",
    "Thumbnail": "xmp: Thumbnails",
}
PRIVATE_IPTC = {
    "Location": "City Sub-location Province-State Country-PrimaryLocationCode Country-PrimaryLocationName ContentLocationCode ContentLocationName",
    "Author": "By-line By-lineTitle Credit Source CopyrightNotice Contact Writer-Editor Destination ProductID",
    "Description": "ObjectName Headline Caption-Abstract LocalCaption Keywords SpecialInstructions SubjectReference Category SupplementalCategories EditStatus FixtureIdentifier DocumentNotes DocumentHistory",
    "CameraModel": "ExifCameraInfo",
    "SerialNumber": "JobID MasterDocumentID ShortDocumentID UniqueDocumentID OwnerID UniqueObjectName OriginalTransmissionReference ReferenceService ReferenceNumber",
    "Timestamp": "DateCreated TimeCreated DigitalCreationDate DigitalCreationTime TimeSent ReleaseDate ReleaseTime ExpirationDate ExpirationTime ReferenceDate",
    "Software": "OriginatingProgram ProgramVersion",
    "Thumbnail": "ObjectPreviewData ObjectPreviewFileFormat ObjectPreviewFileVersion RasterizedCaption",
}
PRIVATE_RESOURCES = {"Author": (1034, 1035, 1051, 1054), "Description": (1008, 1040), "Software": (1057,), "Thumbnail": (1033, 1036)}
PRIVATE_KEYWORDS = {"Author": ("Author",), "Copyright": ("Author",), "Software": ("Software",), "Creation Time": ("Timestamp",), "Source": ("CameraModel", "Software")}  # each is a Description too
PRIVATE_INFO = {"Author": ("IART", "ICOP", "IENG", "ITCH", "ISRC", "IPRD"), "Description": ("INAM", "ICMT", "IKEY", "ISBJ", "IGNR"), "Timestamp": ("ICRD",), "Software": ("ISFT",)}


def _flagged(table: dict[str, str]) -> list[tuple[str, str, str]]:
    """(flag, group, name) of lists in which a group stands before its names."""
    out = []
    for flag, text in table.items():
        group = ""
        for word in text.split():
            if word.endswith(":") or word in ("TIFF", "EXIF"):
                group = word.rstrip(":")
            else:
                out.append((flag, group, word))
    return out


PRIVATE_TAGS = [(g, int(x), f) for f, g, x in _flagged(PRIVATE_EXIF)]
PRIVATE_PROPERTIES = [(f"{g}:{n}", f) for f, g, n in _flagged(PRIVATE_XMP)]
PRIVATE_DATASETS = [(n, f) for f, _, n in _flagged(PRIVATE_IPTC)]
RANKS = ["TIFF", "EXIF", "Interoperability", "GPS"]


def exif_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, t, n, RANKS.index(g)) for g, t, n in EXIF_TAGS + EXIF_ALIASES], "grp string, tag int, tag_name string, rank int")


def exif_meanings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXIF_MEANINGS, "tag int, value long, meaning string")


def iptc_sets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(IPTC_SETS, "record int, dataset int, set_name string, repeats boolean")


def resource_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESOURCES, "lo int, hi int, label string")


def private_tags(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, t, PRIVACY[f]) for g, t, f in PRIVATE_TAGS], "grp string, tag int, flag int")


def values_sql(rows: list[tuple], names: str) -> str:
    """The rows as a derived table of SQL."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") AS d({names})"
