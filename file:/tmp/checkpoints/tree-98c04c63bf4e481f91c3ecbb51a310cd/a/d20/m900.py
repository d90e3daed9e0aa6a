x900