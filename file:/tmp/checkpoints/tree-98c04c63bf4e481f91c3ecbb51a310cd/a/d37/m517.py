x517