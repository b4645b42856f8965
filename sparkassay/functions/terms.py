"""The shipped term map; not yet approved by an operator."""

from __future__ import annotations

# The map, entry by entry.
PAYLOAD = {
    "version": "v1",
    "domain": "public-wiki",
    "status": "draft_unverified",
    "entries": [
        {"ko": "내성 굴림", "ko_aliases": ["내성굴림"], "en": "saving throw", "abbreviation": "내성"},
        {"ko": "명중 굴림", "ko_aliases": ["명중굴림", "공격 굴림"], "en": "attack roll"},
        {"ko": "능력치", "en": "ability score"},
        {"ko": "방어도", "en": "armour class", "abbreviation": "AC"},
        {"ko": "선제권", "en": "initiative"},
        {"ko": "치명타", "en": "critical hit"},
        {"ko": "주문 슬롯", "ko_aliases": ["주문슬롯"], "en": "spell slot"},
        {"ko": "시전", "en": "cast"},
        {"ko": "매혹", "en": "charmed"},
        {"ko": "속박", "en": "restrained"},
        {"ko": "넘어짐", "en": "prone"},
        {"ko": "긴 휴식", "ko_aliases": ["긴휴식"], "en": "long rest"},
        {"ko": "짧은 휴식", "ko_aliases": ["짧은휴식"], "en": "short rest"},
        {"ko": "주사위", "en": "dice"},
        {"ko": "굴림", "en": "roll"},
        {"ko": "발더스 게이트 3", "ko_aliases": ["발더스게이트3", "발더스 게이트3"], "en": "Baldur's Gate 3", "abbreviation": "BG3"},
        {"ko": "주문", "en": "spell", "generic_risk": True},
        {"ko": "이점", "en": "advantage", "generic_risk": True},
        {"ko": "불리점", "en": "disadvantage", "generic_risk": True},
        {"ko": "집중", "en": "concentration", "generic_risk": True},
        {"ko": "공포", "en": "frightened", "generic_risk": True},
        {"ko": "중독", "en": "poisoned", "generic_risk": True},
        {"ko": "은신", "en": "stealth", "generic_risk": True},
        {"ko": "기습", "en": "surprise", "generic_risk": True},
        {"ko": "저항", "en": "resistance", "generic_risk": True},
        {"ko": "취약", "en": "vulnerability", "generic_risk": True},
        {"ko": "면역", "en": "immunity", "generic_risk": True},
        {"ko": "피해", "en": "damage", "generic_risk": True},
    ],
}
