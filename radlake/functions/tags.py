"""Tags: keywords, numbers, representations, and the names that forms and rules use."""

from __future__ import annotations

import re

#: Number, keyword and representation of the tags that have a use here (fixed values).
DICTIONARY = [
    (0x00080016, "SOPClassUID", "UI"), (0x00080018, "SOPInstanceUID", "UI"), (0x00080020, "StudyDate", "DA"), (0x00080021, "SeriesDate", "DA"), (0x00080022, "AcquisitionDate", "DA"),
    (0x00080023, "ContentDate", "DA"), (0x0008002A, "AcquisitionDateTime", "DT"), (0x00080030, "StudyTime", "TM"), (0x00080031, "SeriesTime", "TM"), (0x00080033, "ContentTime", "TM"),
    (0x00080050, "AccessionNumber", "SH"), (0x00080060, "Modality", "CS"), (0x00080080, "InstitutionName", "LO"), (0x00080081, "InstitutionAddress", "ST"), (0x00080082, "InstitutionCodeSequence", "SQ"),
    (0x00080090, "ReferringPhysicianName", "PN"), (0x00080092, "ReferringPhysicianAddress", "ST"), (0x00080096, "ReferringPhysicianIdentificationSequence", "SQ"), (0x0008009C, "ConsultingPhysicianName", "PN"),
    (0x00081010, "StationName", "SH"), (0x00081030, "StudyDescription", "LO"), (0x0008103E, "SeriesDescription", "LO"), (0x00081040, "InstitutionalDepartmentName", "LO"), (0x00081048, "PhysiciansOfRecord", "PN"),
    (0x00081050, "PerformingPhysicianName", "PN"), (0x00081062, "PhysiciansReadingStudyIdentificationSequence", "SQ"), (0x00081070, "OperatorsName", "PN"), (0x00081072, "OperatorIdentificationSequence", "SQ"),
    (0x00081150, "ReferencedSOPClassUID", "UI"), (0x00081155, "ReferencedSOPInstanceUID", "UI"), (0x00100010, "PatientName", "PN"), (0x00100020, "PatientID", "LO"), (0x00100030, "PatientBirthDate", "DA"),
    (0x00100040, "PatientSex", "CS"), (0x00100050, "PatientInsurancePlanCodeSequence", "SQ"), (0x00101000, "OtherPatientIDs", "LO"), (0x00101001, "OtherPatientNames", "PN"), (0x00101002, "OtherPatientIDsSequence", "SQ"),
    (0x00101005, "PatientBirthName", "PN"), (0x00101010, "PatientAge", "AS"), (0x00101040, "PatientAddress", "LO"), (0x00101060, "PatientMotherBirthName", "PN"), (0x00101090, "MedicalRecordLocator", "LO"),
    (0x00102154, "PatientTelephoneNumbers", "SH"), (0x001021B0, "AdditionalPatientHistory", "LT"), (0x00102297, "ResponsiblePerson", "PN"), (0x00104000, "PatientComments", "LT"),
    (0x00180015, "BodyPartExamined", "CS"), (0x00180050, "SliceThickness", "DS"), (0x00181000, "DeviceSerialNumber", "LO"), (0x00181004, "PlateID", "LO"), (0x00181005, "GeneratorID", "LO"), (0x00181007, "CassetteID", "LO"),
    (0x00181008, "GantryID", "LO"), (0x00181030, "ProtocolName", "LO"), (0x00189424, "AcquisitionProtocolDescription", "LT"), (0x0020000D, "StudyInstanceUID", "UI"), (0x0020000E, "SeriesInstanceUID", "UI"),
    (0x00200010, "StudyID", "SH"), (0x00200011, "SeriesNumber", "IS"), (0x00200013, "InstanceNumber", "IS"), (0x00200032, "ImagePositionPatient", "DS"), (0x00200037, "ImageOrientationPatient", "DS"),
    (0x00200052, "FrameOfReferenceUID", "UI"), (0x00201041, "SliceLocation", "DS"), (0x00204000, "ImageComments", "LT"), (0x00280010, "Rows", "US"), (0x00280011, "Columns", "US"), (0x00280030, "PixelSpacing", "DS"),
    (0x00280100, "BitsAllocated", "US"), (0x00281052, "RescaleIntercept", "DS"), (0x00281053, "RescaleSlope", "DS"), (0x00321032, "RequestingPhysician", "PN"), (0x00321060, "RequestedProcedureDescription", "LO"),
    (0x00324000, "StudyComments", "LT"), (0x00400009, "ScheduledProcedureStepID", "SH"), (0x00400254, "PerformedProcedureStepDescription", "LO"), (0x00401001, "RequestedProcedureID", "SH"),
    (0x00401102, "PersonAddress", "ST"), (0x00401103, "TelephoneNumbers", "LO"), (0x00402016, "PlacerOrderNumberImagingServiceRequest", "LO"), (0x00402017, "FillerOrderNumberImagingServiceRequest", "LO"),
    (0x30060002, "StructureSetLabel", "SH"), (0x30060004, "StructureSetName", "LO"), (0x30060008, "StructureSetDate", "DA"), (0x30060010, "ReferencedFrameOfReferenceSequence", "SQ"),
    (0x30060012, "RTReferencedStudySequence", "SQ"), (0x30060014, "RTReferencedSeriesSequence", "SQ"), (0x30060016, "ContourImageSequence", "SQ"), (0x30060020, "StructureSetROISequence", "SQ"),
    (0x30060022, "ROINumber", "IS"), (0x30060024, "ReferencedFrameOfReferenceUID", "UI"), (0x30060026, "ROIName", "LO"), (0x30060028, "ROIDescription", "ST"), (0x3006002A, "ROIDisplayColor", "IS"),
    (0x30060036, "ROIGenerationAlgorithm", "CS"), (0x30060039, "ROIContourSequence", "SQ"), (0x30060040, "ContourSequence", "SQ"), (0x30060042, "ContourGeometricType", "CS"), (0x30060046, "NumberOfContourPoints", "IS"),
    (0x30060050, "ContourData", "DS"), (0x30060080, "RTROIObservationsSequence", "SQ"), (0x30060082, "ObservationNumber", "IS"), (0x30060084, "ReferencedROINumber", "IS"), (0x300600A4, "RTROIInterpretedType", "CS"),
    (0x300E0008, "ReviewerName", "PN"),
]
#: Further ones that rules name (fixed values).
MORE = [
    (0x00080005, "SpecificCharacterSet", "CS"), (0x00080008, "ImageType", "CS"), (0x00080012, "InstanceCreationDate", "DA"), (0x00080013, "InstanceCreationTime", "TM"),
    (0x00080032, "AcquisitionTime", "TM"), (0x00080064, "ConversionType", "CS"), (0x00080068, "PresentationIntentType", "CS"), (0x00080070, "Manufacturer", "LO"), (0x00080100, "CodeValue", "SH"),
    (0x00080102, "CodingSchemeDesignator", "SH"), (0x00080104, "CodeMeaning", "LO"), (0x00080201, "TimezoneOffsetFromUTC", "SH"), (0x00081032, "ProcedureCodeSequence", "SQ"),
    (0x00081080, "AdmittingDiagnosesDescription", "LO"), (0x00081090, "ManufacturerModelName", "LO"), (0x00081111, "ReferencedPerformedProcedureStepSequence", "SQ"),
    (0x00081140, "ReferencedImageSequence", "SQ"), (0x00082111, "DerivationDescription", "ST"), (0x00101020, "PatientSize", "DS"), (0x00101030, "PatientWeight", "DS"), (0x00102160, "EthnicGroup", "SH"),
    (0x001021C0, "PregnancyStatus", "US"), (0x00180010, "ContrastBolusAgent", "LO"), (0x00180020, "ScanningSequence", "CS"), (0x00180021, "SequenceVariant", "CS"), (0x00180022, "ScanOptions", "CS"),
    (0x00180023, "MRAcquisitionType", "CS"), (0x00180024, "SequenceName", "SH"), (0x00180060, "KVP", "DS"), (0x00180080, "RepetitionTime", "DS"), (0x00180081, "EchoTime", "DS"),
    (0x00180082, "InversionTime", "DS"), (0x00180083, "NumberOfAverages", "DS"), (0x00180084, "ImagingFrequency", "DS"), (0x00180086, "EchoNumbers", "IS"), (0x00180087, "MagneticFieldStrength", "DS"),
    (0x00180088, "SpacingBetweenSlices", "DS"), (0x00180090, "DataCollectionDiameter", "DS"), (0x00180091, "EchoTrainLength", "IS"), (0x00181020, "SoftwareVersions", "LO"),
    (0x00181100, "ReconstructionDiameter", "DS"), (0x00181110, "DistanceSourceToDetector", "DS"), (0x00181111, "DistanceSourceToPatient", "DS"), (0x00181120, "GantryDetectorTilt", "DS"),
    (0x00181130, "TableHeight", "DS"), (0x00181140, "RotationDirection", "CS"), (0x00181150, "ExposureTime", "IS"), (0x00181151, "XRayTubeCurrent", "IS"), (0x00181152, "Exposure", "IS"),
    (0x00181160, "FilterType", "SH"), (0x00181170, "GeneratorPower", "IS"), (0x00181190, "FocalSpots", "DS"), (0x00181200, "DateOfLastCalibration", "DA"), (0x00181210, "ConvolutionKernel", "SH"),
    (0x00181314, "FlipAngle", "DS"), (0x00185100, "PatientPosition", "CS"), (0x00200012, "AcquisitionNumber", "IS"), (0x00200020, "PatientOrientation", "CS"), (0x00200060, "Laterality", "CS"),
    (0x00201002, "ImagesInAcquisition", "IS"), (0x00201040, "PositionReferenceIndicator", "LO"), (0x00280002, "SamplesPerPixel", "US"), (0x00280004, "PhotometricInterpretation", "CS"),
    (0x00280008, "NumberOfFrames", "IS"), (0x00280101, "BitsStored", "US"), (0x00280102, "HighBit", "US"), (0x00280103, "PixelRepresentation", "US"), (0x00281050, "WindowCenter", "DS"),
    (0x00281051, "WindowWidth", "DS"), (0x00281054, "RescaleType", "LO"), (0x00400244, "PerformedProcedureStepStartDate", "DA"), (0x00400245, "PerformedProcedureStepStartTime", "TM"),
    (0x00400253, "PerformedProcedureStepID", "SH"), (0x30040002, "DoseUnits", "CS"), (0x30040004, "DoseType", "CS"), (0x3004000A, "DoseSummationType", "CS"), (0x30060006, "StructureSetDescription", "ST"),
    (0x30060009, "StructureSetTime", "TM"), (0x30060085, "ROIObservationLabel", "SH"), (0x300600A6, "ROIInterpreter", "PN"), (0x300A0002, "RTPlanLabel", "SH"), (0x300A0006, "RTPlanDate", "DA"),
    (0x300E0002, "ApprovalStatus", "CS"), (0x300E0004, "ReviewDate", "DA"), (0x300E0005, "ReviewTime", "TM"),
]
BY_NUMBER = {number: (keyword, vr) for number, keyword, vr in DICTIONARY + MORE}
NUMBERS = {keyword: number for number, keyword, _ in DICTIONARY + MORE}
#: Names that are not just the parts of the keyword (fixed values).
_NAMES = {
    "PatientName": "Patient's Name", "PatientBirthDate": "Patient's Birth Date", "PatientSex": "Patient's Sex", "PatientAge": "Patient's Age", "PatientAddress": "Patient's Address",
    "PatientBirthName": "Patient's Birth Name", "PatientMotherBirthName": "Patient's Mother's Birth Name", "PatientTelephoneNumbers": "Patient's Telephone Numbers", "OperatorsName": "Operators' Name",
    "ReferringPhysicianName": "Referring Physician's Name", "ReferringPhysicianAddress": "Referring Physician's Address", "PerformingPhysicianName": "Performing Physician's Name",
    "ConsultingPhysicianName": "Consulting Physician's Name", "PhysiciansOfRecord": "Physician(s) of Record", "OtherPatientIDs": "Other Patient IDs", "OtherPatientIDsSequence": "Other Patient IDs Sequence",
    "PatientInsurancePlanCodeSequence": "Patient's Insurance Plan Code Sequence", "PersonAddress": "Person's Address", "TelephoneNumbers": "Person's Telephone Numbers",
    "PhysiciansReadingStudyIdentificationSequence": "Physician(s) Reading Study Identification Sequence", "ImagePositionPatient": "Image Position (Patient)", "ImageOrientationPatient": "Image Orientation (Patient)",
    "ReferencedFrameOfReferenceUID": "Referenced Frame of Reference UID", "FrameOfReferenceUID": "Frame of Reference UID", "ReferencedFrameOfReferenceSequence": "Referenced Frame of Reference Sequence",
    "FillerOrderNumberImagingServiceRequest": "Filler Order Number / Imaging Service Request", "PlacerOrderNumberImagingServiceRequest": "Placer Order Number / Imaging Service Request",
    "KVP": "KVP", "ManufacturerModelName": "Manufacturer's Model Name", "PatientSize": "Patient's Size", "PatientWeight": "Patient's Weight", "ContrastBolusAgent": "Contrast/Bolus Agent",
    "EchoNumbers": "Echo Number(s)", "FocalSpots": "Focal Spot(s)", "SoftwareVersions": "Software Versions", "NumberOfAverages": "Number of Averages", "NumberOfFrames": "Number of Frames",
    "DistanceSourceToDetector": "Distance Source to Detector", "DistanceSourceToPatient": "Distance Source to Patient", "DateOfLastCalibration": "Date of Last Calibration", "XRayTubeCurrent": "X-Ray Tube Current",
    "GantryDetectorTilt": "Gantry/Detector Tilt", "ImagesInAcquisition": "Images in Acquisition", "SamplesPerPixel": "Samples per Pixel", "TimezoneOffsetFromUTC": "Timezone Offset From UTC",
    "NumberOfContourPoints": "Number of Contour Points", "RTROIInterpretedType": "RT ROI Interpreted Type", "RTROIObservationsSequence": "RT ROI Observations Sequence",
}


def name_of(keyword: str) -> str:
    """The name of a tag: its keyword in words."""
    return _NAMES.get(keyword) or " ".join(re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z][a-z]+|[A-Z]+|\d+", keyword))


def tag_id(number: int) -> str:
    return f"({number >> 16:04X},{number & 0xFFFF:04X})"


def forms(keyword: str) -> list[str]:
    """The keys under which a tag can stand in a map: keyword, name, (GGGG,EEEE) in both cases."""
    out = [keyword, name_of(keyword)]
    if keyword in NUMBERS:
        out += [tag_id(NUMBERS[keyword]), tag_id(NUMBERS[keyword]).lower()]
    return list(dict.fromkeys(out))
