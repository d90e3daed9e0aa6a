x116