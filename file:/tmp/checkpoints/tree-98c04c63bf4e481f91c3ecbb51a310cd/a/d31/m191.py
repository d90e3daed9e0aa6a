x191