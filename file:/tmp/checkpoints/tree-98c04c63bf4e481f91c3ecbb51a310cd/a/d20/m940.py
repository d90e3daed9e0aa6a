x940