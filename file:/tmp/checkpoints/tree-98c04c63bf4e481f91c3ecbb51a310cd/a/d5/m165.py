x165