x513