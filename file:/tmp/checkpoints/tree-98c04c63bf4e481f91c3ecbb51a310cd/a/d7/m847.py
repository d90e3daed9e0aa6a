x847