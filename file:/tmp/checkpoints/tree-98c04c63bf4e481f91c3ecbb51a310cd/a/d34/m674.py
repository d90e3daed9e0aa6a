x674