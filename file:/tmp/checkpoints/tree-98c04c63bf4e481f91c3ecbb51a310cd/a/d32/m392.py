x392