x169