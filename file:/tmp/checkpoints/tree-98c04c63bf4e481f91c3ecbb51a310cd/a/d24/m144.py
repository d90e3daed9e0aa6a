x144