"""Parameters and word lists of the detection rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    trigger_all: float = 0.85
    trigger_verify: float = 0.60
    window_s: float = 15.0
    distinct_count: int = 2
    spotted_confidence: float = 0.65
    corroboration_distance: float = 0.15
    word_similarity: float = 75.0
    word_coverage: float = 0.75
    text_threshold: float = 0.55
    discount: float = 0.9
    logprob_floor: float = -1.0
    episode_gap_s: float = 10.0
    agree_ratio: float = 80.0
    agree_s: float = 3.0
    context_words: int = 60
    heartbeat_s: float = 20.0
    heartbeat_after_trigger_s: float = 10.0
    retain_days: int = 30
    retain_flagged_days: int = 180


RULES = Rules()

#: Words that carry no distress by themselves.
NON_DISTINCTIVE = (
    "please now right the a an i im me my you your he she it we they this that is am are was "
    "to of in on at here there and or so oh okay ok yeah yes well just what"
).split()

#: Words that cannot anchor a match.
FUNCTION_WORDS = NON_DISTINCTIVE + (
    "do dont does doesnt did didnt want wants wanted need needs have has be been can cant will wont "
    "would should not no ill its for from being"
).split()

#: Words skipped in front of a leading "dont".
LEAD_SKIP = ("please", "no", "oh", "just")

#: Everyday phrases that an enrolled phrase must differ from.
ORDINARY_PHRASES = (
    "how are you doing",
    "what a lovely day",
    "I need to go now",
    "can you help me with this",
    "I'm really tired",
    "call me later",
    "let's get out of here",
    "I'm on my way",
    "see you soon",
)

#: The English phrases, in list order.
PHRASES_EN = (
    "Call the police, I need help",
    "I'm not safe",
    "Get away from me",
    "Someone is following me",
    "I need help right now",
    "Don't touch me",
    "I'm being followed",
    "Help me, please",
    "I'm scared, stay back",
    "Let go of me",
    "I need the police here",
    "Someone is trying to hurt me",
    "Please don't hurt me",
    "I don't feel safe here",
    "Stay away from me",
    "I'm in danger",
    "Somebody help me now",
    "I want to go home now",
    "Please call for help",
    "I need to get out of here",
)
#: The same phrases in Hindi.
PHRASES_HI = (
    "पुलिस को बुलाओ, मुझे मदद चाहिए",
    "मैं सुरक्षित नहीं हूं",
    "मुझसे दूर हटो",
    "कोई मेरा पीछा कर रहा है",
    "मुझे अभी मदद चाहिए",
    "मुझे मत छुओ",
    "मेरा पीछा किया जा रहा है",
    "मदद करो, कृपया",
    "मुझे डर लग रहा है, दूर रहो",
    "मुझे छोड़ दो",
    "मुझे यहां पुलिस चाहिए",
    "कोई मुझे नुकसान पहुंचाने की कोशिश कर रहा है",
    "कृपया मुझे मत मारो",
    "मुझे यहां सुरक्षित महसूस नहीं हो रहा",
    "मुझसे दूर रहो",
    "मैं खतरे में हूं",
    "कोई अभी मेरी मदद करो",
    "मुझे अभी घर जाना है",
    "कृपया मदद के लिए कॉल करो",
    "मुझे यहां से निकलना है",
)
#: The same phrases in Telugu.
PHRASES_TE = (
    "పోలీసులకు కాల్ చేయండి, నాకు సహాయం కావాలి",
    "నేను సురక్షితంగా లేను",
    "నా నుండి దూరంగా వెళ్ళు",
    "ఎవరో నన్ను వెంబడిస్తున్నారు",
    "నాకు ఇప్పుడే సహాయం కావాలి",
    "నన్ను తాకవద్దు",
    "నన్ను ఎవరో వెంబడిస్తున్నారు",
    "దయచేసి నాకు సహాయం చేయండి",
    "నాకు భయంగా ఉంది, దూరంగా ఉండు",
    "నన్ను వదిలేయ్",
    "నాకు ఇక్కడ పోలీసులు కావాలి",
    "ఎవరో నన్ను గాయపరచడానికి ప్రయత్నిస్తున్నారు",
    "దయచేసి నన్ను గాయపరచవద్దు",
    "నాకు ఇక్కడ సురక్షితంగా అనిపించడం లేదు",
    "నా నుండి దూరంగా ఉండు",
    "నేను ప్రమాదంలో ఉన్నాను",
    "ఎవరైనా ఇప్పుడే నాకు సహాయం చేయండి",
    "నాకు ఇప్పుడే ఇంటికి వెళ్లాలి",
    "దయచేసి సహాయం కోసం కాల్ చేయండి",
    "నేను ఇక్కడ నుండి బయటపడాలి",
)
#: The same phrases in Kannada.
PHRASES_KN = (
    "ಪೊಲೀಸರಿಗೆ ಕರೆ ಮಾಡಿ, ನನಗೆ ಸಹಾಯ ಬೇಕು",
    "ನಾನು ಸುರಕ್ಷಿತವಾಗಿಲ್ಲ",
    "ನನ್ನಿಂದ ದೂರ ಹೋಗು",
    "ಯಾರೋ ನನ್ನನ್ನು ಹಿಂಬಾಲಿಸುತ್ತಿದ್ದಾರೆ",
    "ನನಗೆ ಈಗಲೇ ಸಹಾಯ ಬೇಕು",
    "ನನ್ನನ್ನು ಮುಟ್ಟಬೇಡ",
    "ನನ್ನನ್ನು ಯಾರೋ ಹಿಂಬಾಲಿಸುತ್ತಿದ್ದಾರೆ",
    "ದಯವಿಟ್ಟು ನನಗೆ ಸಹಾಯ ಮಾಡಿ",
    "ನನಗೆ ಭಯವಾಗುತ್ತಿದೆ, ದೂರವಿರು",
    "ನನ್ನನ್ನು ಬಿಡು",
    "ನನಗೆ ಇಲ್ಲಿ ಪೊಲೀಸರು ಬೇಕು",
    "ಯಾರೋ ನನಗೆ ಹಾನಿ ಮಾಡಲು ಪ್ರಯತ್ನಿಸುತ್ತಿದ್ದಾರೆ",
    "ದಯವಿಟ್ಟು ನನಗೆ ಹಾನಿ ಮಾಡಬೇಡಿ",
    "ನನಗೆ ಇಲ್ಲಿ ಸುರಕ್ಷಿತ ಎನಿಸುತ್ತಿಲ್ಲ",
    "ನನ್ನಿಂದ ದೂರವಿರು",
    "ನಾನು ಅಪಾಯದಲ್ಲಿದ್ದೇನೆ",
    "ಯಾರಾದರೂ ಈಗಲೇ ನನಗೆ ಸಹಾಯ ಮಾಡಿ",
    "ನನಗೆ ಈಗಲೇ ಮನೆಗೆ ಹೋಗಬೇಕು",
    "ದಯವಿಟ್ಟು ಸಹಾಯಕ್ಕಾಗಿ ಕರೆ ಮಾಡಿ",
    "ನಾನು ಇಲ್ಲಿಂದ ಹೊರಬರಬೇಕು",
)
#: The same phrases in Tamil.
PHRASES_TA = (
    "போலீசை அழையுங்கள், எனக்கு உதவி வேண்டும்",
    "நான் பாதுகாப்பாக இல்லை",
    "என்னிடமிருந்து விலகிச் செல்",
    "யாரோ என்னைப் பின்தொடர்கிறார்கள்",
    "எனக்கு இப்போதே உதவி தேவை",
    "என்னைத் தொடாதே",
    "என்னை யாரோ பின்தொடர்கிறார்கள்",
    "தயவுசெய்து எனக்கு உதவுங்கள்",
    "எனக்குப் பயமாக இருக்கிறது, தூரமாக இரு",
    "என்னை விடு",
    "எனக்கு இங்கே போலீஸ் வேண்டும்",
    "யாரோ என்னைக் காயப்படுத்த முயற்சிக்கிறார்கள்",
    "தயவுசெய்து என்னைத் துன்புறுத்தாதே",
    "இங்கே எனக்குப் பாதுகாப்பாக உணரவில்லை",
    "என்னிடமிருந்து விலகி இரு",
    "நான் ஆபத்தில் இருக்கிறேன்",
    "யாராவது இப்போதே எனக்கு உதவுங்கள்",
    "எனக்கு இப்போதே வீட்டிற்குப் போக வேண்டும்",
    "தயவுசெய்து உதவிக்கு அழையுங்கள்",
    "நான் இங்கிருந்து வெளியேற வேண்டும்",
)
#: The numbers of the phrases that are common in ordinary talk.
VERIFY_BY_DEFAULT = (14, 18, 20)
LANGUAGES = {"en": PHRASES_EN, "hi": PHRASES_HI, "te": PHRASES_TE, "kn": PHRASES_KN, "ta": PHRASES_TA}
