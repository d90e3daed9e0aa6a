x468