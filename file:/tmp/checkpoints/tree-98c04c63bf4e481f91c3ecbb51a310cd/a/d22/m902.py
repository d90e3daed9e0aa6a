x902